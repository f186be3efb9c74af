"""Problem 3: mapping freely written values to a canonical list.

The distinct values are normalised and looked up in an inverted index of character trigrams over the reference
list. Candidates are scored by the cosine of idf weights and taken from the best down to the threshold; the
first ones that write all content words of the value and no others are it, if no entry besides comes as close
as the margin. Values that concepts share are resolved once, and joined to the concepts again.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

#: Least cosine of a candidate; entries whose cosines lie this near are equally close; most entries of a list.
THRESHOLD, MARGIN, MOST_ENTRIES = 0.15, 0.02, 200_000
#: Scores held at once when values are looked up.
SCORES_AT_ONCE = 4_000_000
UNMATCHED = "unmatched"

#: Articles, prepositions and words for any piece of work; they name no concept of their own.
FILLERS = frozenset(
    "a an the our this that these its of for in on to with and new novel proposed so called data ours approach approaches method methods technique techniques framework task tasks model models problem problems system algorithm strategy procedure module scheme improved".split()
)
#: What is written where a value is missing.
PLACEHOLDERS = frozenset("na none null nil unknown other misc tbd todo untitled".split())

_COMMAND = re.compile(r"\\[a-zA-Z]+\*?\s*\{([^{}]*)\}")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_TOKEN = re.compile(r"[^\W_]+")
_SHORTENED = re.compile(r"([^\W\d_]{3,})\.(?=\s|$)")
_BRACKETS = re.compile(r"\(([^()]*)\)|\[([^\[\]]*)\]")


def _plain(value: str) -> str:
    if not value.isascii():
        value = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", value))
        value = "".join(c for c in value if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    if "\\" in value:
        for _ in range(3):
            value = _COMMAND.sub(r"\1", value)
    if "<" in value:
        value = _TAG.sub(" ", value)
    # camel case only where the value is one word of several humps; capitals alone are an acronym
    return " ".join(_CAMEL.sub(" ", w) if re.search("[a-z]", w) else w for w in value.split())


def stem(token: str) -> str:
    """Singular form by the ending."""
    if len(token) > 4 and token.endswith("ies"):
        return token[:-3] + "y"
    if len(token) > 4 and token.endswith("s") and not token.endswith("ss"):
        return token[:-1]
    return token


def content_words(value: str | None) -> tuple[str, ...]:
    """The content words of a value, singular and in lower case; its fillers are dropped, also in brackets,
    and so is an acronym in brackets that abbreviates the words before it. Null and blank give none."""
    if not value:
        return ()
    text = _plain(value)

    def bracket(m: re.Match) -> str:
        inside = _TOKEN.findall((m[1] if m[1] is not None else m[2]).lower())
        before = _TOKEN.findall(text[: m.start()].lower())
        initials = "".join(t[0] for t in before if t not in FILLERS)
        return " " if len(inside) == 1 and len(inside[0]) > 1 and initials.endswith(inside[0]) else f" {m[0][1:-1]} "

    text = _BRACKETS.sub(bracket, text).lower()
    short = set(_SHORTENED.findall(text))
    found = [t for t in _TOKEN.findall(text.replace("'s ", " ").replace("’s ", " ")) if t not in FILLERS]
    # a shortened word keeps its full stop
    return tuple(t + "." if t in short else stem(t) for t in found)


def within(a: str, b: str, most: int) -> bool:
    """Whether at most `most` insertions, deletions, substitutions or swaps of neighbours turn a into b."""
    if abs(len(a) - len(b)) > most:
        return False
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return False
        older, old = old, row
    return old[-1] <= most


def _grams(words: tuple[str, ...]) -> Counter:
    """The trigrams of the words, their ends marked; a shortened word has no end."""
    return Counter(g for w in words for padded in (f" {w[:-1]}" if w.endswith(".") else f" {w} ",) for g in (padded[i : i + 3] for i in range(max(1, len(padded) - 2))))


class CanonicalIndex:
    """The inverted index of the reference list; small enough for every worker."""

    def __init__(self, entries: list[tuple[str, str | None, list[str | None] | None]]):
        # words written with a hyphen, as one
        self.compounds = frozenset("".join(p) for _, name, _ in entries for w in (name or "").lower().split() if "-" in w and len(p := content_words(w)) == 2)
        self.compound_grams = defaultdict(set)
        for c in self.compounds:
            for g in _grams((c,)):
                self.compound_grams[g].add(c)
        keys: dict[tuple[str, ...], set[str]] = defaultdict(set)
        for entry, name, aliases in entries:
            for value in (name, *(aliases or ())):
                if words := self.words(value):
                    keys[tuple(sorted(words))].add(entry)
                    # the words as one, for values written without any space
                    keys[("".join(words),)].add(entry)
        self.keys = list(keys)
        self.entries = [frozenset(keys[k]) for k in self.keys]
        self.known = frozenset(w for k in self.keys for w in k)
        grams = [_grams(k) for k in self.keys]
        self.gram = {g: n for n, g in enumerate(sorted({g for c in grams for g in c}))}
        holders = Counter(g for c in grams for g in c)
        self.unseen = float(np.log(1 + len(grams)))
        self.idf = np.array([np.log(1 + len(grams) / holders[g]) for g in self.gram])
        lists: list[list[tuple[int, float]]] = [[] for _ in self.gram]
        for n, c in enumerate(grams):
            weights = {self.gram[g]: f * self.idf[self.gram[g]] for g, f in c.items()}
            norm = np.sqrt(sum(w * w for w in weights.values()))
            for g, w in weights.items():
                lists[g].append((n, w / norm))
        self.post = [(np.array([x[0] for x in p], dtype=np.int64), np.array([x[1] for x in p])) for p in lists]
        sizes = np.array([len(k) for k in self.keys], dtype=int)
        self.fits = lru_cache(None)(lambda n: (sizes == n) | (sizes == 1))
        self.slips = lru_cache(500_000)(self._slips)

    def words(self, value: str | None) -> tuple[str, ...]:
        """The content words of a value, neighbours that write a compound joined."""
        found = content_words(value)
        if not self.compounds or len(found) < 2:
            return found
        out: list[str] = []
        at = 0
        while at < len(found):
            if at + 1 < len(found) and self._compound("".join(found[at : at + 2])):
                out.append("".join(found[at : at + 2]))
                at += 2
            else:
                out.append(found[at])
                at += 1
        return tuple(out)

    def _compound(self, pair: str) -> bool:
        """Whether two words in a row write a compound, with one slip at most."""
        if pair in self.compounds:
            return True
        if len(pair) >= 12:
            return False
        near = set().union(*(self.compound_grams.get(g, ()) for g in _grams((pair,))))
        return any(within(pair, c, 1) for c in near)

    def _slips(self, word: str, wanted: str, lone: bool) -> int | None:
        """By how many slips the word writes the wanted one; None if it doesn't. A word of the list writes itself
        only, a short one and a lone acronym are written exactly."""
        if word == wanted:
            return 0
        if word in self.known:
            return None
        if word.endswith("."):
            return 0 if stem(word[:-1]) == wanted else 1 if wanted.startswith(word[:-1]) else None
        if lone or len(word) < 3:
            return None
        return 1 if within(word, wanted, 1) else 2 if min(len(word), len(wanted)) >= 9 and within(word, wanted, 2) else None

    def writes(self, words: tuple[str, ...], key: tuple[str, ...]) -> bool:
        """Whether the words, in any order, write exactly the words of the key."""
        if len(words) != len(key):
            return words != key and len(key) == 1 and "".join(words) == key[0]
        left = list(key)
        rest = []
        for w in words:
            if w in left:
                left.remove(w)
            else:
                rest.append(w)
        if not rest:
            return True
        if any(w in self.known for w in rest):
            return False
        # few words are left: every one must have a partner of its own
        options = [[n for n, k in enumerate(left) if self.slips(w, k, len(key) == 1) is not None] for w in rest]
        return _matched(options, frozenset())

    def candidates(self, values: list[tuple[str, ...]]) -> Iterator[list[tuple[int, float]]]:
        """For each value, the keys of as many words, or of one, from the best cosine down to the threshold: (number, cosine)."""
        size = max(1, len(self.keys))
        step = max(1, SCORES_AT_ONCE // size)
        for lo in range(0, len(values), step):
            numbers, parts, norms = [], [], []
            some = values[lo : lo + step]
            for n, words in enumerate(some):
                squares = 0.0
                for g, f in _grams(words).items():
                    at = self.gram.get(g)
                    w = f * (self.unseen if at is None else self.idf[at])
                    squares += w * w
                    if at is not None:
                        ids, weights = self.post[at]
                        numbers.append(ids + n * size)
                        parts.append(weights * w)
                norms.append(np.sqrt(squares) or 1.0)
            if not numbers:
                yield from ([] for _ in some)
                continue
            scores = np.bincount(np.concatenate(numbers), np.concatenate(parts), minlength=len(some) * size).reshape(len(some), size) / np.array(norms)[:, None]
            for words, row in zip(some, scores, strict=True):
                good = np.flatnonzero((row >= THRESHOLD) & self.fits(len(words)))
                best = np.round(row[good], 9)
                order = np.argsort(-best, kind="stable")
                yield list(zip(good[order].tolist(), best[order].tolist(), strict=True))

    def match(self, values: list[str | None]) -> list[tuple[frozenset[str], float]]:
        """For each value, the entries that it writes equally closely (one, if it is clear), and the score."""
        each = [self.words(v) for v in values]
        distinct = list(dict.fromkeys(w for w in each if w))
        found = {w: self._closest(w, listed) for w, listed in zip(distinct, self.candidates(distinct), strict=True)}
        return [found.get(w, (frozenset(), 0.0)) for w in each]

    def _closest(self, words: tuple[str, ...], listed: list[tuple[int, float]]) -> tuple[frozenset[str], float]:
        best, entries = None, set()
        for n, score in listed:
            if best is not None and score < best - MARGIN:
                break
            if self.writes(words, self.keys[n]):
                best = score if best is None else best
                entries |= self.entries[n]
        return frozenset(entries), best or 0.0

    def resolve(self, name: str | None, aliases: list[str | None] | None) -> tuple[str, float]:
        """The entry of one concept and its score, or unmatched; the rule of map_to_canonical for a single value."""
        (named, score), *others = self.match([name, *(aliases or ())])
        if len(named) == 1:
            return next(iter(named)), score
        if named or says_nothing(name):
            for entries, s in others:
                if len(entries := entries & named if entries & named else entries) == 1:
                    return next(iter(entries)), s
        return UNMATCHED, score


def _matched(options: list[list[int]], taken: frozenset[int]) -> bool:
    return not options or any(_matched(options[1:], taken | {n}) for n in options[0] if n not in taken)


def says_nothing(name: str | None) -> bool:
    """No content word of two letters or more, a placeholder, or a lone acronym."""
    words = content_words(name)
    return all(w in PLACEHOLDERS or len(w) < 2 for w in words) or (len(words) == 1 and len(words[0]) <= 6)


_VALUES = "value string, entries array<string>, score double, nothing boolean"


def _resolved(values: DataFrame, listed: list[tuple]) -> DataFrame:
    """(value, entries, score, nothing) of a table of distinct values."""
    shared = values.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CanonicalIndex(shared.value)
        for batch in batches:
            held = batch.column(0).to_pylist()
            found = index.match(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(e) for e, _ in found], pa.list_(pa.string())), pa.array([s for _, s in found], pa.float64()), pa.array([says_nothing(v) for v in held], pa.bool_())],
                ["value", "entries", "score", "nothing"],
            )

    return values.mapInArrow(run, _VALUES)


def map_to_canonical(concepts: DataFrame, reference: DataFrame, keys: tuple[str, ...] = ("paper_id", "local_id"), name: str = "name", aliases: str = "aliases", entry: str = "id", entry_name: str = "canonical_name", entry_aliases: str = "aliases") -> DataFrame:
    """(keys, concept_id, score): one row per distinct key; concept_id is the entry or `unmatched`.

    The name decides; where it writes no entry clearly, and says nothing or writes several, the first alias that
    writes one (of these, if any) does. A name with an unknown content word besides known ones says something
    else, and no alias overrides it. Rows delivered twice count once; null and blank names rely on the aliases,
    nulls among these are skipped. The score is the cosine, 1 for the same words.
    The reference list is held by every worker and may have MOST_ENTRIES rows; a longer one is refused.
    """
    spark = concepts.sparkSession
    rows = reference.select(entry, entry_name, entry_aliases).where(F.col(entry).isNotNull()).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    held = [F.col(f"`{k}`") for k in keys]
    once = concepts.select(*held, F.col(name).alias("_name"), F.col(aliases).alias("_aliases")).dropDuplicates(list(keys))
    strings = F.array().cast("array<string>")
    values = once.select(F.explode(F.concat(F.array("_name"), F.coalesce("_aliases", strings))).alias("value")).where("value is not null").distinct()
    path = shared_folder(spark, "values")
    # few bytes are much work here: as many tasks as the session has threads, or partitions of a shuffle
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    _resolved(values.repartition(tasks), [(str(r[0]), r[1], r[2]) for r in rows]).write.parquet(path)
    found = spark.read.schema(_VALUES).parquet(path)

    named = once.join(found.withColumnRenamed("value", "_name"), "_name", "left")
    clear = F.size(F.coalesce("entries", strings)) == 1
    open_ = ~clear & ((F.size(F.coalesce("entries", strings)) > 1) | F.coalesce("nothing", F.lit(True)))
    score = F.coalesce("score", F.lit(0.0)).alias("score")
    told = named.where(~open_).select(*held, F.when(clear, F.col("entries")[0]).otherwise(UNMATCHED).alias("concept_id"), score)

    asked = named.where(open_).select(*held, F.coalesce("entries", strings).alias("_named"), score, F.posexplode_outer("_aliases").alias("_pos", "_alias"))
    answers = found.select(F.col("value").alias("_alias"), F.col("entries").alias("_entries"), F.col("score").alias("_score"))
    both = F.array_intersect("_entries", "_named")
    one = F.when(F.size(both) > 0, both).otherwise(F.col("_entries"))
    first = F.min(F.when(F.size(one) == 1, F.struct("_pos", one[0].alias("entry"), "_score"))).alias("first")
    by_alias = asked.join(answers, "_alias", "left").groupBy(*held).agg(first, F.max("score").alias("score"))
    return told.unionByName(by_alias.select(*held, F.coalesce("first.entry", F.lit(UNMATCHED)).alias("concept_id"), F.coalesce("first._score", "score").alias("score")))
