"""Reading level of each English prose document, by propagation over a document-word graph.

Documents are one side of the graph, the words of their prose the other; an edge weighs the
logarithm of the count. Graded documents are clamped to their mean grade. Harmonic iterations
run both ways: a word takes the weighted mean of its documents' difficulty, a document that of
its words, where a word counts by how well it tells levels apart (the inverse square of its
variance over documents, taken from the first rounds and then kept). After those, graded
documents weigh as much as all others together, so the iterations contract by about one half
and are repeated until no word, and hence no document, moves by more than a stated residual. The resulting
continuous difficulty is cut into levels at the four places that agree best with the grades.

Words are keys of 64 bits. What goes from one iteration to the next is a level and a trust for
each word. Vocabularies of up to ``VOCABULARY`` words are sent to the executors as two arrays,
and documents stay where they are; larger ones stay tables that meet the edges in joins. Both
ways compute the same.

Prose is found first: lines and sentences of mostly alphabetic words with English function
words among them; logs, tables, lists of hashes, settings and other languages have none. A
text with fewer than three of them is asked for its points: main clauses of five words or more
between semicolons, dashes or coordinating conjunctions.

Defined cases: null, empty and non-prose texts, and texts of fewer than three sentences or
points have no row; several grades of a document are averaged, null grades ignored; grades of
unknown documents do nothing; without any grade the result is empty; a document none of whose
words was reached takes the mean grade; repeated keys are documents of their own; very long
texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.session import Stages

#: Words whose levels are sent to executors (24 bytes each, 48 MB in all); larger vocabularies are joined.
VOCABULARY = 2_000_000
#: Graded documents used to place the cuts between levels, at most.
CUT_SAMPLE = 50_000
#: Sentences or points that make running prose, and words of a clause that is a point.
LEAST, CLAUSE = 3, 5
#: Rounds in which the trust in words is measured, and the move at which the iterations end.
TRUST_ROUNDS, RESIDUAL, MOST_ROUNDS = 4, 0.002, 200

# English function words.
FUNCTION_WORDS = frozenset(
    "a all also and any are as at be because been before being between but by can could did do does down each every few for from had has have he her here his how i if in into is it "
    "its may me might more most must my no nor not now of off on once only or other our out over own same shall she should so some such than that the their them then there these they "
    "this those through to under until up us was we were what when where which while who whom whose why will with within without would you your".split()
)
_UNIT = re.compile("[\r\n\x0b\x0c\x85\u2028\u2029]+|(?<=[.!?…;。])\\s+")
_MARKS = str.maketrans({c: " " for c in ".,;:!?…\"“”()[]*•–—\ufeff"} | {"’": "'"})
_INNER = str.maketrans("", "", "-'")
_CLAUSE = re.compile(r"[,;]? (?:and|but|or|nor|so|yet|then) (?:then )?|;\s+| [–—-]+ ")


class _Kinds(dict):
    """Of a word: 1 if it is alphabetic, and FUNCTION more if it is a function word; remembered within a bound."""

    FUNCTION = 1 << 32

    def __missing__(self, w: str) -> int:
        kind = int(w.isalpha() or w.translate(_INNER).isalpha()) + (self.FUNCTION if w in FUNCTION_WORDS else 0)
        if len(self) < 300_000:
            self[w] = kind
        return kind


class _Hashes(dict):
    """64-bit keys of words, remembered within a bound."""

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63)
        if len(self) < 300_000:
            self[w] = h
        return h


_kinds, _hashes = _Kinds(), _Hashes()


def prose(text: str) -> tuple[int, list[list[str]]]:
    """The number of sentences and points of English prose, and their words."""
    units, kept = [], []
    plain = _UNIT.sub("\n", text)
    for line in plain.split("\n"):
        w = line.translate(_MARKS).lower().split()
        n = len(w)
        if n < 3:
            continue
        function, alphabetic = divmod(sum(map(_kinds.__getitem__, w)), _Kinds.FUNCTION)
        if function >= 0.12 * n and alphabetic >= 0.75 * n:
            units.append(w)
            kept.append(line)
    if not 0 < len(units) < LEAST:
        return len(units), units
    return sum(max(1, sum(len(c.split()) >= CLAUSE for c in _CLAUSE.split(u.lower()))) for u in kept), units


def _binary(values: np.ndarray, ends: list[int]) -> pa.Array:
    """Slices of an array of numbers as binary values."""
    offsets = np.asarray(ends, dtype=np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _numbers(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binary values in a row, and how many each value holds."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype=dtype), np.diff(at) // np.dtype(dtype).itemsize


def graph(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, words, weights, mass)``: the edges of each prose document, as packed 64-bit keys and 32-bit floats, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, counts, ends = [], [], [], [0]
            for i, t in enumerate(batch.column(1).to_pylist()):
                points, units = prose(t) if t else (0, [])
                if points < LEAST:
                    continue
                seen = Counter()
                for u in units:
                    seen.update(u)
                rows.append(i)
                words += map(_hashes.__getitem__, seen)
                counts += seen.values()
                ends.append(len(words))
            weight = np.log1p(np.asarray(counts, dtype=np.float32))
            mass = np.add.reduceat(weight, ends[:-1]).astype(np.float64) if rows else np.zeros(0)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), _binary(np.asarray(words, dtype=np.int64), ends), _binary(weight, ends), pa.array(mass)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "words", "weights", "mass"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, words binary, weights binary, mass double")


def _edges(batch: pa.RecordBatch, dtype: type = np.int32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and weight of each edge, and the grades (NaN where there is none)."""
    word, sizes = _numbers(batch.column("words"), dtype)
    grade = batch.column("grade").to_numpy(zero_copy_only=False).astype(np.float64)
    return np.repeat(np.arange(batch.num_rows), sizes), word, _numbers(batch.column("weights"), np.float32)[0].astype(np.float64), grade


def _scores(row: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int, level: np.ndarray, trust: np.ndarray, mean: float) -> np.ndarray:
    """Each document as the weighted mean of its words."""
    w = weight * trust[word]
    total = np.bincount(row, w, minlength=n)
    return np.where(total > 0, np.bincount(row, w * level[word], minlength=n) / np.maximum(total, 1e-300), mean)


class _Arrays:
    """Rounds with the words' levels in arrays: documents are read once per round, partial sums are added up."""

    def __init__(self, nodes: DataFrame, known: DataFrame, stages: Stages, mean: float, clamp: float):
        self.mean, self.clamp = mean, clamp
        self.kind = nodes.schema[nodes.columns[0]].dataType.simpleString()
        keys = np.sort(known.toPandas().word.to_numpy())
        self.size = len(keys)

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, sizes = _numbers(batch.column("words"), np.int64)
                ends = [0, *np.cumsum(sizes).tolist()]
                yield batch.set_column(batch.schema.get_field_index("words"), "words", _binary(np.searchsorted(keys, word).astype(np.int32), ends))

        self.nodes = stages.cut(nodes.mapInArrow(number, nodes.schema), "numbered")
        self.columns = self.nodes.select("words", "weights", "grade")

    def sums(self, state: tuple[np.ndarray, np.ndarray] | None, clamp: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word the sums of weight, weight x level and weight x level squared over documents; graded ones weigh ``clamp`` times."""
        mean, size = self.mean, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, size))
            for batch in batches:
                row, word, weight, grade = _edges(batch)
                given = ~np.isnan(grade)
                level = grade if state is None else np.where(given, grade, _scores(row, word, weight, batch.num_rows, *state, mean))
                pull = np.where(given, clamp, 0.0 if state is None else 1.0)[row] * weight
                x = np.nan_to_num(level)[row]
                for k in range(3):
                    sums[k] += np.bincount(word, pull * x**k if k else pull, minlength=size)
            used = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(s[used]) for s in sums]], names=["word", "s0", "s1", "s2"])

        parts = self.columns.where("grade is not null") if state is None else self.columns
        parts = parts.mapInArrow(run, "word int, s0 double, s1 double, s2 double")
        got = parts.groupBy("word").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).toPandas()  # one row per word
        out = np.zeros((3, size))
        out[:, got.word.to_numpy()] = got[["s0", "s1", "s2"]].to_numpy().T
        return out[0], out[1], out[2]

    def measured(self, state: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Levels and trust anew."""
        s0, s1, s2 = self.sums(state)
        safe = np.maximum(s0, 1e-300)
        spread = np.maximum(s2 / safe - (s1 / safe) ** 2, 0) + 0.05
        return s1 / safe, np.where(s0 > 0, s0 / (s0 + 1) / spread**2, 0)

    def moved(self, state: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], float]:
        """Levels anew under the same trust, and how far the farthest trusted word moved."""
        s0, s1, _ = self.sums(state, self.clamp)
        level = np.where(s0 > 0, s1 / np.maximum(s0, 1e-300), state[0])
        return (level, state[1]), float(np.abs(level - state[0])[state[1] > 0].max(initial=0.0))

    def scored(self, state: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """``(key, grade, difficulty)`` of every document."""
        key, mean = self.nodes.columns[0], self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, word, weight, _ = _edges(batch)
                score = _scores(row, word, weight, batch.num_rows, *state, mean)
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("grade"), pa.array(score)], names=[key, "grade", "difficulty"])

        return self.nodes.mapInArrow(run, f"{key} {self.kind}, grade double, difficulty double")


class _Joins:
    """The same rounds with the words' levels as a table that meets the edges in joins."""

    def __init__(self, nodes: DataFrame, stages: Stages, mean: float, clamp: float):
        self.nodes, self.stages, self.mean, self.clamp = nodes, stages, mean, clamp

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, word, weight, _ = _edges(batch, np.int64)
                docs = batch.select(["doc", "grade"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), pa.array(word), pa.array(weight)], names=["doc", "grade", "word", "weight"])

        self.docs = stages.cut(nodes.withColumn("doc", F.monotonically_increasing_id()), "docs")
        self.edges = stages.cut(self.docs.select("doc", "grade", "words", "weights").mapInArrow(flat, "doc bigint, grade double, word bigint, weight double"), "edges")

    def _levels(self, state: DataFrame) -> DataFrame:
        w = F.col("weight") * F.col("trust")
        met = self.edges.join(state, "word").groupBy("doc").agg((F.sum(w * F.col("level")) / F.nullif(F.sum(w), F.lit(0.0))).alias("x"))
        return met

    def _sums(self, state: DataFrame | None, clamp: float = 1.0) -> DataFrame:
        e = self.edges
        if state is None:
            e, level = e.where("grade is not null"), F.col("grade")
        else:
            e = e.join(self._levels(state), "doc", "left")
            level = F.coalesce("grade", "x", F.lit(self.mean))
        pull = F.col("weight") * F.when(F.col("grade").isNotNull(), clamp).otherwise(1.0)
        return e.groupBy("word").agg(F.sum(pull).alias("s0"), F.sum(pull * level).alias("s1"), F.sum(pull * level * level).alias("s2"))

    def measured(self, state: DataFrame | None) -> DataFrame:
        level = F.col("s1") / F.col("s0")
        spread = F.greatest(F.col("s2") / F.col("s0") - level * level, F.lit(0.0)) + 0.05
        return self.stages.cut(self._sums(state).select("word", level.alias("level"), (F.col("s0") / (F.col("s0") + 1) / (spread * spread)).alias("trust")), "state")

    def moved(self, state: DataFrame) -> tuple[DataFrame, float]:
        new = self._sums(state, self.clamp).select("word", (F.col("s1") / F.col("s0")).alias("new"))
        both = self.stages.cut(state.join(new, "word").select("word", F.col("new").alias("level"), "trust", F.abs(F.col("new") - F.col("level")).alias("move")), "state")
        return both.select("word", "level", "trust"), both.agg(F.max("move")).first()[0] or 0.0

    def scored(self, state: DataFrame) -> DataFrame:
        key = self.nodes.columns[0]
        return self.docs.select("doc", key, "grade").join(self._levels(state), "doc", "left").select(key, "grade", F.coalesce("x", F.lit(self.mean)).alias("difficulty"))


def vocabulary(nodes: DataFrame) -> DataFrame:
    """``word``: the distinct words of the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_numbers(batch.column("words"), np.int64)[0]))], names=["word"])

    return nodes.select("words").mapInArrow(run, "word bigint").distinct()


def cuts(score: np.ndarray, grade: np.ndarray, levels: int = 5) -> np.ndarray:
    """Scores between neighbouring levels at which the fewest grades are on the wrong side."""
    order = np.argsort(score, kind="stable")
    s, g = score[order], grade[order]
    between = np.concatenate([[s[0] - 1], (s[:-1] + s[1:]) / 2, [s[-1] + 1]])
    out = []
    for k in range(1, levels):
        high_below = np.concatenate([[0], np.cumsum(g > k + 0.5 - 1e-9)])
        low_above = (g < k + 0.5).sum() - np.concatenate([[0], np.cumsum(g < k + 0.5)])
        wrong = high_below + low_above
        out.append(between[np.flatnonzero(wrong == wrong.min())].mean())
    return np.maximum.accumulate(out)


def levels(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "reading_level", residual: float = RESIDUAL, in_arrays: int = VOCABULARY
) -> DataFrame:
    """``(key, reading_level, difficulty)`` of each English prose document."""
    spark = docs.sparkSession
    stages = Stages(spark, "reading")
    grades = labels.where(F.col(grade).isNotNull()).groupBy(key).agg(F.avg(grade).alias("grade"))
    nodes = stages.cut(graph(docs, key, text).join(grades, key, "left"), "graph")
    kind = nodes.schema[key].dataType.simpleString()
    mean, given, mass = nodes.agg(F.avg("grade"), F.sum(F.when(F.col("grade").isNotNull(), F.col("mass"))), F.sum("mass")).first()
    if mean is None:
        return spark.createDataFrame([], f"{key} {kind}, reading_level int, difficulty double")
    known = stages.cut(vocabulary(nodes), "vocabulary")
    clamp = max(1.0, (mass - given) / given)
    rounds = _Arrays(nodes, known, stages, mean, clamp) if known.count() <= in_arrays else _Joins(nodes, stages, mean, clamp)
    state = None
    for _ in range(TRUST_ROUNDS):
        state = rounds.measured(state)
    for _ in range(MOST_ROUNDS):
        state, move = rounds.moved(state)
        if move <= residual:
            break
    else:
        raise RuntimeError(f"levels still move by {move} after {MOST_ROUNDS} rounds")
    scored = rounds.scored(state)
    graded = scored.where("grade is not null").orderBy(F.xxhash64(key)).limit(CUT_SAMPLE).select("grade", "difficulty").toPandas()
    at = cuts(graded.difficulty.to_numpy(), graded.grade.to_numpy())
    level = sum((F.when(F.col("difficulty") > float(c), 1).otherwise(0) for c in at), F.lit(1))
    return scored.select(key, level.cast("int").alias("reading_level"), "difficulty")
