import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import encoding as E

PATH = E.default_path()
WHOLE = E._vocabulary(PATH)[0]


def test_the_plain_encoder_is_the_public_one():
    assert isinstance(WHOLE, tiktoken.Encoding)
    assert WHOLE.encode_ordinary("Hello world") == [15496, 995]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\r\u00a0\u3000.,'’-<|>sStTdmre0129ab今日はアナー・一é\u0301😀")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_cuts_never_change_the_ids(text):
    assert E.encode_text(text, PATH) == (WHOLE.encode_ordinary(text) if text else [])


def test_cuts_stand_where_no_token_goes_across():
    never = E._vocabulary(PATH)[1]
    assert E.cut_points("two words\nhere", never) == [3, 9]
    assert not E.cut_points("", never) and not E.cut_points("x", never)


def test_round_trip_of_a_very_long_text():
    text = "Ein langer Text, 今日は晴れ。 " * 20_000
    assert WHOLE.decode(E.encode_text(text, PATH)) == text


def test_table(spark):
    rows = [(1, "Hello world", 5), (2, "", 5), (3, None, 5), (4, " \n", 5), (5, "<|endoftext|>", 5), (5, "<|endoftext|>", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = [(r[0], r[1]) for r in E.encode_corpus(df).orderBy("doc_id").collect()]
    assert got[:4] == [(1, [15496, 995]), (2, []), (3, []), (4, WHOLE.encode_ordinary(" \n"))]
    assert len(got) == 6 and got[4][1] == WHOLE.encode_ordinary("<|endoftext|>") and 50256 not in got[4][1]
    assert E.encode_corpus(df.limit(0)).count() == 0
