"""Problem 8: texts cut off by their source, by a structural completeness check.

A stack automaton follows quotes, brackets and inline elements over the end of each text, and the last line is
classed: closed by a terminator, list entry, keywords, table row, code, reference, signature, title, or open
prose. Broken characters, escapes and cut marks decide alone; other ends are weighed against baselines.

* Open prose is cut if its source is used to end its prose with a terminator, if the text ends at the source's
  field limit, or if its last word says so. A source's habit is its own rate of terminators, drawn to that of
  all sources as long as it has few texts.
* Entries and titles have no terminator. Such an end is cut if that is likelier than that a whole one looks so:
  the source's own share of cut texts against the chance that a whole entry ends in an unseen tail, in an
  unseen word, or in a word that elsewhere always goes on. These chances are counted over the whole corpus, so
  that a small corpus needs stronger signs and a large one fewer; nothing is switched off.

Each document yields one small row of features, written once with counted tails and words; the baselines are
their aggregates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

#: A tail is known from this many lines, and from this share of them where cut ones count themselves.
KNOWN_FROM, KNOWN_SHARE = 2, 0.01
#: Texts of the whole corpus by which a source's own rates are smoothed; rate from which a source is used to terminators.
SMOOTHING, USED_TO = 10.0, 0.5
#: Share of a word's occurrences at the end of a phrase from which it is no sign of a cut.
ENDS_PHRASES = 0.1
#: Words counted in a task before they are handed on.
MOST_WORDS = 200_000
#: A fixed length is a source's field limit if at least this many and this share of its texts end there.
LIMIT_TEXTS, LIMIT_SHARE = 3, 0.02
#: Words of a line that may be a term by itself.
SHORT = 3
#: Kinds of an end that are cut by themselves, and kinds for which the baseline decides.
BY_ITSELF = ("mark", "broken", "open", "cut_code", "cut_reference")
BY_TAIL = ("list", "keywords", "title", "signature", "status", "term")
#: Of these, the ones whose last word is looked at, and those that are always a text's last line.
BY_WORD, ALWAYS_LAST = ("list", "keywords", "title", "term"), ("signature", "status")

_CLOSED = re.compile(r"[.!?。！？؟।][\"'”’」』»)\]}*_]*$")
#: The signs by which sources mark a cut.
_MARK = re.compile(r"(?:…|\.\.\.|\[\s*(?:…|\.\.\.|truncated|cut|more|continued)\s*\]|\((?:…|\.\.\.|truncated|continued|more)\)|(?:read|show|see) more|<truncated>|»»|>>>)$", re.I)
_BROKEN = re.compile(r"[�\ud800-\udfff]$|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|&(?:#\d*|#x[0-9a-fA-F]*|[a-zA-Z]{1,6})$|%[0-9A-Fa-f]?$(?<![0-9 ]%)|Ã$|â€?$")
_ITEM = re.compile(r"^\s*(?:[-*•+–]|\(?(?:\d{1,3}|[ivx]{1,5}|[a-z])[.)])\s+")
_KEYWORDS = re.compile(r"^\s*(?:key ?words?|index terms|tags|topics|schlagw[oö]rter|schlüsselwörter|stichwörter|mots[- ]clés|キーワード)\s*[:：]", re.I)
_SIGNATURE = re.compile(r"^\s*(?:—|–|--)\s*\S")
_STATUS = re.compile(r"^\s*version\s+\d[\d.]*\s*,", re.I)
_REFERENCE_END = re.compile(r"(?:\bpp?\.\s*\d+\s*[-–]+\s*\d+|\b(?:19|20)\d\d\)?|\bdoi:\S+|https?://\S+)$")
_REFERENCE = re.compile(r"^\s*\[\d+\]\s|\bpp?\.(?:\s|$)|\bet al\.?$")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:def |for |if |while |return\b|import |from \w+ import|class |print\(|SELECT |INSERT |UPDATE |#include|std::|var |let |const |function )|^\s*[\w.\[\]]+\s*(?:[-+*/]?=)\s*\S|^\s*[\w.]+\(.*\)\s*[:;]?\s*$|^\s*#\s")
_FORMULA = re.compile(r"^[\w(),\s]{1,24}=\s*\S|^\s*\$\$|\\\]$|\\end\{\w+\*?\}$")
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’」』)\]]*(?:\s|(?<=[。！？])|(?<=[。！？][」』]))")
_OPEN, _CLOSE = "([{“「『«„", ")]}”」』»"
_PAIR = dict(zip(_CLOSE, _OPEN, strict=False))
#: What stands for a text that isn't there; so does a text without letters.
_PLACEHOLDER = re.compile(r"(?:[\W\d_]*|tb[acd]|todo|n/?a|none|null|nil|nan|unknown|untitled|empty|abstract|summary|(?:no|not) (?:abstract|text|available|applicable)|to be (?:added|announced|confirmed|done)|coming soon)\s*:?", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
#: A word of a script with spaces, and the sign behind it.
_FOLLOWED = re.compile(r"([a-z\u00df-\u024f\u0370-\u04ff]+)(?=(.))", re.S)
_ELEMENT = re.compile(r"<(/?)(a|b|i|u|em|strong|code|sub|sup|span|small|s|q)(?:\s[^<>]*)?>", re.I)


def unclosed(text: str) -> str:
    """The quotes, brackets and inline elements (as <) that are open at the end. A closing sign without its
    opening one is passed over."""
    stack: list[str] = []
    if "<" in text:
        open_elements: list[str] = []
        for closing, name in ((m[1], m[2].lower()) for m in _ELEMENT.finditer(text)):
            if not closing:
                open_elements.append(name)
            elif name in open_elements:
                del open_elements[len(open_elements) - 1 - open_elements[::-1].index(name)]
        stack += ["<"] * len(open_elements)
    for c in text:
        if c == "“" and "„" in stack:  # the German closing sign
            while stack.pop() != "„":
                pass
        elif c in _OPEN:
            stack.append(c)
        elif c in _PAIR and _PAIR[c] in stack:
            while stack.pop() != _PAIR[c]:
                pass
    return "".join(stack)


def _tail(entry: str) -> str:
    """What an entry ends with, without its first word where it has several."""
    words = entry.lower().split()
    return " ".join(words[1:] or words)


def _title_like(line: str) -> bool:
    """Capitals throughout, or a label and a colon, or a few words without a full clause."""
    words = line.split()
    if not words or len(words) > 14 or _CJK.search(line):
        return False
    long_words = [w for w in words[1:] if len(w) > 3 and w[0].isalpha()]
    if words[0][:1].isupper() and long_words and all(w[0].isupper() for w in long_words):
        return True
    return ": " in line and "," not in line or len(words) <= 2


def _last_word(line: str) -> str:
    found = _LETTERS.findall(line.lower())
    return found[-1] if found else ""


def examine(text: str | None) -> tuple[str, str]:
    """(kind, key) of the end of a text. The kind says what stands there; the key, if any, is its tail to be
    looked up in the baseline of that kind."""
    end = (text or "").rstrip()
    if not end.strip("​﻿­"):
        return "empty", ""
    if _MARK.search(end):
        return "mark", ""
    if _BROKEN.search(end):
        return "broken", ""
    lines = end.splitlines()
    last = lines[-1].rstrip()
    block: list[str] = []
    for line in reversed(lines):
        if not line.strip():
            break
        block.insert(0, line)
    if last.lstrip().startswith("```") and sum(x.lstrip().startswith("```") for x in lines) % 2 == 0:
        return "code", ""
    # code and formulas come before the terminator: theirs may end in anything
    if _is_code(block):
        return ("code", "") if not unclosed("\n".join(block)) and _code_ends(last) else ("cut_code", "")
    if _CLOSED.search(end):
        sentence = _SENTENCE_END.split(last.rstrip())
        tail = last if len(sentence) < 2 else last[last.rfind(sentence[-1]) - 1 if sentence[-1] else 0 :]
        return ("open", "") if set(unclosed(tail)) & set("(“「『«<") else ("closed", "")
    if sum(x.lstrip().startswith("```") for x in lines) % 2:
        return "open", ""
    if _KEYWORDS.match(last):
        listed = re.split(r"[,;、]\s*", _KEYWORDS.sub("", last))
        return ("keywords", _tail(listed[-1])) if listed[-1].strip() else ("open", "")
    if _ITEM.match(last):
        body = _ITEM.sub("", last)
        return ("prose", _last_word(last)) if _SENTENCE_END.search(body) else ("list", _tail(body))
    if re.fullmatch(r"\s*(?:[-*•+]|\d+[.)]?)\s*", last) and len(lines) > 1 and _ITEM.match(lines[-2]):
        return "open", ""
    if ("\t" in last or last.count("|") >= 2) and not _SENTENCE_END.search(last):
        cell = re.split(r"[\t|]", last.rstrip("| "))[-1].strip()
        return ("table", "") if cell else ("open", "")
    if len(block) > 1 and ("\t" in block[-2] or re.fullmatch(r"\s*(?:table|figure|tabelle|tableau|表)\s*\d+", block[-2], re.I)):
        return "open", ""
    if re.fullmatch(r"\s*(?:table|figure|tabelle|tableau|表)\s*\d+", last, re.I) and len(lines) > 1:
        return "closed", ""
    if _SIGNATURE.match(last):
        return "signature", _last_word(last)
    if _STATUS.match(last):
        return "status", _last_word(last)
    if _FORMULA.search(last) and not _SENTENCE_END.search(last):
        return ("open", "") if unclosed(last) or re.search(r"[-+*/=,(^_]$", last) else ("formula", "")
    if _REFERENCE.search(last) or (_REFERENCE_END.search(last) and "," in last):
        return ("reference", "") if _REFERENCE_END.search(last) and not unclosed(last) else ("cut_reference", "")
    if _SENTENCE_END.search(last):
        return "prose", _last_word(last)
    words = last.split()
    if len(lines) == 1 and _PLACEHOLDER.fullmatch(last.strip()):
        return "placeholder", ""
    if len(lines) == 1 and len(words) <= SHORT and not _CJK.search(last) and (_title_like(last) or not last.lstrip()[:1].isupper()) and not unclosed(last) and last[-1] not in ",;:-–—":
        return "term", " ".join(words).lower()
    if _title_like(last) and not unclosed(last) and last[-1] not in ",;:-–—":
        return "title", _last_word(last)
    return "prose", _last_word(last)


def _is_code(block: list[str]) -> bool:
    hits = [bool(_CODE.search(x)) for x in block]
    if len(block) == 1:
        # a lone line of prose may look like one statement
        return hits[0] and bool(re.search(r"[;{}]\s*$|^\s*(?:SELECT |def |print\(|return\b|import |std::|#include)", block[0]))
    return hits[0] and sum(hits[:-1]) >= max(1, (len(block) - 1) / 2)


def _code_ends(last: str) -> bool:
    """A last statement is whole unless it ends in an operator, or is a lone word."""
    s = last.strip()
    return not re.search(r"[-+*/=,(\[{<>&|.]$", s) and not re.fullmatch(r"[\w.]+", s) or s in ("end", "}", "pass", "break", "continue", "fi", "done")


def baseline_of(text: str | None) -> Counter:
    """(kind, tail) of the lines of a text that are surely whole, as the text goes on after them; a term is a tail of entries and keywords."""
    found: Counter = Counter()
    if not text:
        return found
    lines = text.rstrip().splitlines()
    for n, line in enumerate(lines[:-1]):
        s = line.strip()
        if not s or _CLOSED.search(s):
            continue
        if _KEYWORDS.match(s):
            for x in re.split(r"[,;、]\s*", _KEYWORDS.sub("", s)):
                if x.strip():
                    found["keywords", _tail(x)] += 1
        elif _ITEM.match(s):
            found["list", _tail(_ITEM.sub("", s))] += 1
        elif (n == 0 or not lines[n - 1].strip()) and _title_like(s):
            found["title", _last_word(s)] += 1
    # the keywords before the last one of a last line are whole as well
    if lines and _KEYWORDS.match(lines[-1]):
        for x in re.split(r"[,;、]\s*", _KEYWORDS.sub("", lines[-1]))[:-1]:
            if x.strip():
                found["keywords", _tail(x)] += 1
    # a short text is whole if it is a term that the corpus lists
    for (kind, tail), n in list(found.items()):
        if kind in ("list", "keywords") and len(tail.split()) <= SHORT:
            found["term", tail] += n
    return found


_FEATURES = "doc_id bigint, source string, chars int, kind string, key string, n bigint, goes_on bigint, ends bigint"
_COLUMNS = [x.split()[0] for x in _FEATURES.split(", ")]


def _followed(text: str) -> list[tuple[str, str]]:
    """Each word and the sign behind it; the last word of a text has none and isn't counted."""
    return _FOLLOWED.findall(text.rstrip().lower())


def _features(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row per document; the counted tails (doc_id null, kind prefixed by +) and words (kind +word) of each task."""

    def counted(tails: Counter, words: Counter) -> pa.RecordBatch:
        n, goes_on, ends = Counter(), Counter(), Counter()
        for (word, sign), times in words.items():
            n[word] += times
            if sign == " ":
                goes_on[word] += times
            elif sign in ".,;:!?)":
                ends[word] += times
        rows = [(None, None, None, "+" + kind, k, times, 0, 0) for (kind, k), times in tails.items()]
        rows += [(None, None, None, "+word", w, times, goes_on[w], ends[w]) for w, times in n.items()]
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails: Counter = Counter()
        words: Counter = Counter()
        for batch in batches:
            ids, sources, texts = (batch.column(n).to_pylist() for n in range(3))
            rows = []
            for i, s, t in zip(ids, sources, texts, strict=True):
                kind, k = examine(t)
                rows.append((i, s, None if t is None else len(t), kind, k, 1, 0, 0))
                tails.update(baseline_of(t))
                if kind in ALWAYS_LAST:
                    tails[kind, k] += 1
                if t:
                    words.update(_followed(t))
            yield _batch(rows)
            if len(words) + len(tails) > MOST_WORDS:
                yield counted(tails, words)
                tails, words = Counter(), Counter()
        yield counted(tails, words)

    return documents.select(F.col(key).cast("bigint"), source, text).mapInArrow(run, _FEATURES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _COLUMNS)


def _sources(docs: DataFrame) -> DataFrame:
    """(source, habit, rate, limit_chars) of each source.

    habit: how often its prose ends in a terminator; rate: its share of cut texts as far as single texts tell;
    both smoothed by the whole corpus. limit_chars: the length of its longest texts, if many have it.
    """
    by_length = docs.where("kind <> 'empty'").groupBy("source", "chars").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "closed").alias("closed"), F.count_if(F.col("kind") == "prose").alias("prose"), F.count_if(F.col("kind").isin(*BY_ITSELF)).alias("told"),
    )
    each = by_length.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n", "closed", "prose", "told")], F.max(F.struct("chars", "n")).alias("longest"))
    total = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "closed", "prose", "told")]).first()  # one row
    # without texts that say otherwise, prose ends in a terminator
    terminators = (total["closed"] + SMOOTHING) / (total["closed"] + total["prose"] + SMOOTHING)
    told = (total["told"] + (total["prose"] if terminators >= USED_TO else 0) + 1) / (total["n"] + 20)
    habit = (F.col("closed") + SMOOTHING * terminators) / (F.col("closed") + F.col("prose") + SMOOTHING)
    limit = F.when((F.col("longest.n") >= LIMIT_TEXTS) & (F.col("longest.n") >= LIMIT_SHARE * F.col("n")), F.col("longest.chars"))
    return each.select("source", habit.alias("habit"), ((F.col("told") + F.when(habit >= USED_TO, F.col("prose")).otherwise(0) + SMOOTHING * told) / (F.col("n") + SMOOTHING)).alias("rate"), limit.alias("limit_chars"))


def _last(key: Column) -> Column:
    return F.regexp_extract(key, r"([a-z\x{df}-\x{24f}\x{370}-\x{4ff}]+)[^\p{L}]*$", 1)


def _surprise(words: DataFrame) -> tuple[DataFrame, float]:
    """(word, surprise): how much rarer than usual a whole phrase ends in this word; and the same for an unseen word."""
    counted = words.groupBy(F.col("key").alias("word")).agg(*[F.sum(c).alias(c) for c in ("n", "goes_on", "ends")])
    total = counted.agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"), F.sum("n").alias("n")).first()  # one row
    unseen = ((total["once"] or 0) + 1) / ((total["n"] or 0) + 1)
    share = (F.col("ends") + 1) / (F.col("goes_on") + F.col("ends") + 2)
    return counted.select("word", F.least(F.lit(1.0), share / ENDS_PHRASES).alias("surprise")), min(1.0, unseen)


def examined_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, chars, kind, cut), one row per row of documents.

    Empty and null texts are never cut. A null source is a source of its own. All baselines count all texts;
    an empty table gives no rows.
    """
    spark = documents.sparkSession
    path = shared_folder(spark, "text-ends")
    _features(documents, key, text, source).write.parquet(path)
    rows = spark.read.schema(_FEATURES).parquet(path)
    docs = rows.where(~F.col("kind").startswith("+"))
    sources = _sources(docs)
    words, unseen = _surprise(rows.where("kind = '+word'"))
    tails = rows.where("kind like '+%' and kind <> '+word'").groupBy(F.expr("substr(kind, 2)").alias("kind"), "key").agg(F.sum("n").alias("n"))
    totals = {r["kind"]: r["n"] for r in tails.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # one row per kind
    # signatures are always last lines, so that a cut one counts itself: its tail must be a common one
    by_kind = lambda values, other: reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(float(values[k]))), values, F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(float(other)))
    least = by_kind({k: max(KNOWN_FROM, KNOWN_SHARE * totals.get(k, 0)) for k in ALWAYS_LAST}, KNOWN_FROM)
    known = tails.where(F.col("n") >= least)
    explained = {r["kind"]: r["n"] for r in known.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    new_tail = by_kind({k: 1 - explained.get(k, 0) / (totals.get(k, 0) + 1e-9) if totals.get(k) else 1.0 for k in BY_TAIL}, 1.0)

    # what each distinct end says, whatever source it comes from: the chance that a whole entry ends so
    ends = docs.where(F.col("kind").isin(*BY_TAIL, "prose")).select("kind", "key").distinct().withColumn("word", _last(F.col("key")))
    told = ends.join(known.select("kind", "key", F.lit(True).alias("known")), ["kind", "key"], "left").join(words, "word", "left")
    of_word = F.when((F.col("word") == "") | F.col("kind").isin(*ALWAYS_LAST), F.lit(1.0)).otherwise(F.coalesce("surprise", F.lit(unseen)))
    said = told.select("kind", "key", F.coalesce("known", F.lit(False)).alias("known"), (F.when(F.col("kind") == "prose", 1.0).otherwise(new_tail) * of_word).alias("whole_so"))

    # most texts end in a terminator: they stay out of the joins, where they'd be one hot key
    weighed = docs.where(F.col("kind").isin(*BY_TAIL, "prose")).join(said, ["kind", "key"], "left")
    with_source = weighed.withColumn("_source", F.coalesce("source", F.lit("\x00"))).join(sources.withColumn("_source", F.coalesce("source", F.lit("\x00"))).drop("source"), "_source", "left")
    likelier = F.col("rate") > (1 - F.col("rate")) * F.col("whole_so")
    cut = F.when(F.col("kind") == "prose", (F.col("habit") >= USED_TO) | F.coalesce(F.col("chars") == F.col("limit_chars"), F.lit(False)) | likelier).otherwise(~F.col("known") & likelier)
    others = docs.where(~F.col("kind").isin(*BY_TAIL, "prose"))
    return others.select("doc_id", "source", "chars", "kind", F.col("kind").isin(*BY_ITSELF).alias("cut")).unionByName(with_source.select("doc_id", "source", "chars", "kind", F.coalesce(cut, F.lit(False)).alias("cut")))


def cut_shares(examined: DataFrame) -> DataFrame:
    """(source, texts, cut, share, limit_chars): how often each source cuts, and its field limit if many texts end at one length."""
    kept = examined.where("kind <> 'empty'")
    by_length = kept.groupBy("source", "chars").agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("c"))
    return by_length.groupBy("source").agg(
        F.sum("n").alias("texts"),
        F.sum("c").alias("cut"),
        (F.sum("c") / F.sum("n")).alias("share"),
        F.max(F.struct("chars", "n")).alias("longest"),
    ).select("source", "texts", "cut", "share", F.when((F.col("longest.n") >= LIMIT_TEXTS) & (F.col("longest.n") >= LIMIT_SHARE * F.col("texts")), F.col("longest.chars")).alias("limit_chars"))
