"""Sources mixed to target weights (problem 7).

Iterative proportional fitting rakes the token weights of (source, language, topic) cells:
sources to their target shares, languages and topics to the shares they have in the corpus.
No cell's weight passes its source's cap on repeats.  Documents are then drawn by their
calibrated weight: the whole part as copies, the rest by systematic sampling.

Sizes are tokens of a public tokenizer, counted in Arrow batches; the same pass stores the
hashed token counts of every document in the shared folder.  Topics are centres of these
counts (spherical k-means over all documents, a pass over the stored counts for every round),
and every document gets the nearest.  Vectors lie on a grid of ``1 / GRID``, so that all sums
are exact and the topics depend neither on the layout of the table nor on the order of its rows.

Defined results: documents without text or without target source are not used; a source
without documents, or whose cap on repeats is null or 0, stays at 0 and is reported; copies of a document are documents of their
own; an empty corpus gives an empty mixture; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefold.session import stored

#: Name of a public tokenizer's file, or its whole path.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Bytes that cannot hold a token border are not split; longer texts are counted in pieces of this many characters.
PIECE = 50_000

# Language codes that the corpus is raked on; anything else is "other".
LANGUAGES = ("en", "de", "es", "fr")
#: Hashed token counts that a topic is told by.
FEATURES = 512
#: Steps of 1 in the vectors and centres of topics: products are whole multiples of 2 ** -40, so sums below 2 ** 13 are exact.
GRID = 2.0 ** 20


def _encoding(tokenizer: str):
    import public_tokenizers
    import tiktoken

    with open(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class Topics:
    """Weights of hashed token counts and cluster centres of unit length."""

    weights: np.ndarray
    centres: np.ndarray

    def nearest(self, counts: np.ndarray) -> np.ndarray:
        """Number of the centre nearest to each row of counts."""
        return self.closeness(_vectors(_sparse(counts), self.weights)).argmax(axis=1)

    def closeness(self, x: np.ndarray) -> np.ndarray:
        """Cosines of vectors (rows) and centres (columns), exact on the grid."""
        return x @ self.centres.T


@dataclass(frozen=True)
class Sparse:
    """Hashed token counts of ``size`` documents: the entries above 0."""

    size: int
    row: np.ndarray
    feature: np.ndarray
    count: np.ndarray


def _sparse(counts: np.ndarray) -> Sparse:
    row, feature = np.nonzero(counts)
    return Sparse(len(counts), row, feature, counts[row, feature])


def _vectors(c: Sparse, weights: np.ndarray) -> np.ndarray:
    """Vectors of unit length on the grid, a row for each document."""
    v = np.log1p(c.count) * weights[c.feature]
    length = np.maximum(np.sqrt(np.bincount(c.row, v * v, minlength=c.size)), 1e-12)
    x = np.zeros((c.size, FEATURES))
    x[c.row, c.feature] = np.round(v / length[c.row] * GRID) / GRID
    return x


def _sums(c: Sparse, fitted: Topics) -> np.ndarray:
    """Sum of the vectors nearest to each centre, in units of the grid."""
    x = _vectors(c, fitted.weights)
    mine = fitted.closeness(x).argmax(axis=1)[:, None] == np.arange(len(fitted.centres))
    return np.round((mine.T.astype(float) @ x) * GRID).astype(np.int64)


class Local:
    """Passes over counts in memory."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts

    def presence(self) -> np.ndarray:
        """Documents with each feature, at the end all documents."""
        return np.append((self.counts > 0).sum(axis=0), len(self.counts))

    def farthest(self, fitted: Topics) -> np.ndarray:
        """Counts of the document that is farthest from all centres."""
        return self.counts[fitted.closeness(_vectors(_sparse(self.counts), fitted.weights)).max(axis=1, initial=-1.0).argmin()]

    def sums(self, fitted: Topics) -> np.ndarray:
        return _sums(_sparse(self.counts), fitted)


class Stored:
    """Passes over a table of ``doc_id, features, counts``; ties of distance go by hash of the document."""

    def __init__(self, counted: DataFrame) -> None:
        self.counted = counted.select(F.xxhash64("doc_id").alias("h"), "features", "counts")

    def presence(self) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(FEATURES + 1, dtype=np.int64)
            for _, c in _chunks(batches):
                total += np.append(np.bincount(c.feature, minlength=FEATURES), c.size)
            yield _table(place=np.arange(FEATURES + 1), n=total)

        return self._added(count, FEATURES + 1)

    def farthest(self, fitted: Topics) -> np.ndarray:
        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, c in _chunks(batches):
                near = fitted.closeness(_vectors(c, fitted.weights)).max(axis=1, initial=-1.0)
                ties = np.flatnonzero(near == near.min())
                k = int(ties[piece.column("h").to_numpy()[ties].argmin()])
                yield pa.RecordBatch.from_arrays([pa.array([near[k]]), *[piece.column(name).slice(k, 1) for name in ("h", "features", "counts")]], names=["near", "h", "features", "counts"])

        r = self.counted.mapInArrow(far, "near double, h bigint, features binary, counts binary").orderBy("near", "h", "features", "counts").first()
        out = np.zeros(FEATURES)
        out[np.frombuffer(r.features, dtype=np.int16)] = np.frombuffer(r.counts, dtype=np.int32)
        return out

    def sums(self, fitted: Topics) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(fitted.centres.shape, dtype=np.int64)
            for _, c in _chunks(batches):
                total += _sums(c, fitted)
            place = np.flatnonzero(total)
            yield _table(place=place, n=total.ravel()[place])

        return self._added(add, fitted.centres.size).reshape(fitted.centres.shape)

    def _added(self, task, size: int) -> np.ndarray:
        """Sums of the tasks' numbers by place; ``size`` numbers reach the driver."""
        out = np.zeros(size, dtype=np.int64)
        for r in self.counted.mapInArrow(task, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
            out[r.place] = r.n
        return out


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=pa.int64()) for v in columns.values()], names=list(columns))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[tuple[pa.RecordBatch, Sparse]]:
    """Pieces of the batches, with their counts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            (features, ends), (counts, _) = _numbers(piece.column("features"), np.int16), _numbers(piece.column("counts"), np.int32)
            yield piece, Sparse(piece.num_rows, np.repeat(np.arange(piece.num_rows), np.diff(ends)), features, counts)


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column without nulls, and their borders: no work for each row."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset)
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2] or b"", dtype=kind, count=int(ends[-1] - ends[0]) // size, offset=int(ends[0])), (ends - ends[0]) // size


def fit_topics(counts: np.ndarray | Local | Stored, topics: int = 6, rounds: int = 20) -> Topics:
    """Spherical k-means on hashed token counts, rare tokens weighing more; starts far apart."""
    passes = Local(counts) if isinstance(counts, np.ndarray) else counts
    *present, size = passes.presence()
    if not size:
        return Topics(np.ones(FEATURES), np.zeros((1, FEATURES)))
    fitted = Topics(np.log((1 + size) / (1 + np.array(present))), np.zeros((0, FEATURES)))
    for _ in range(min(topics, int(size))):
        start = _vectors(_sparse(passes.farthest(fitted)[None, :]), fitted.weights)
        fitted = Topics(fitted.weights, np.vstack([fitted.centres, start]))
    for _ in range(rounds):
        sums = passes.sums(fitted).astype(float)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, np.round(sums / np.maximum(length, 1.0) * GRID) / GRID, fitted.centres)
        if np.array_equal(centres, fitted.centres):
            break
        fitted = Topics(fitted.weights, centres)
    return fitted


def count_tokens(documents: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, to: str = "tokens", features: bool = False) -> DataFrame:
    """The documents with the number of tokens of their whole text (0 for none), and with ``features`` their hashed counts above 0 (numbers of features, int16, and their counts, int32, as bytes)."""
    names = [c for c in documents.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes if c != text) + f", `{to}` bigint" + (", features binary, counts binary" if features else "")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            columns = [batch.column(i) for i in range(len(names))]
            if not features:
                columns.append(pa.array([_size(encoding, t) for t in texts], type=pa.int64()))
            else:
                each = [hashed_counts(encoding, t) for t in texts]
                there = [np.flatnonzero(c) for c in each]
                columns.append(pa.array([int(c.sum()) for c in each], type=pa.int64()))
                columns.append(pa.array([f.astype(np.int16).tobytes() for f in there], type=pa.binary()))
                columns.append(pa.array([c[f].astype(np.int32).tobytes() for c, f in zip(each, there)], type=pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, to, *(["features", "counts"] if features else [])])

    return documents.select(*names, text).mapInArrow(count, schema)


def with_topics(counted: DataFrame, fitted: Topics) -> DataFrame:
    """The columns before ``features`` and ``counts``, and the topic of every document."""
    names = [c for c in counted.columns if c not in ("features", "counts")]
    schema = ", ".join(f"`{c}` {t}" for c, t in counted.dtypes if c in names) + ", topic string"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, c in _chunks(batches):
            near = fitted.closeness(_vectors(c, fitted.weights)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], pa.array([f"topic_{k}" for k in near], type=pa.string())], names=[*names, "topic"])

    return counted.mapInArrow(assign, schema)


def hashed_counts(encoding, text: str | None) -> np.ndarray:
    """Tokens of a whole text, counted by their number modulo ``FEATURES``."""
    out = np.zeros(FEATURES)
    for piece in _pieces(text):
        out += np.bincount(np.asarray(encoding.encode_ordinary(piece), dtype=np.int64) % FEATURES, minlength=FEATURES)
    return out


def _pieces(text: str | None) -> Iterator[str]:
    """A text, or a very long one cut at blanks, where no token ends inside a word."""
    at = 0
    while text and at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            end = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = at + PIECE if end <= at else end
        yield text[at:end]
        at = end


def _size(encoding, text: str | None) -> int:
    """Tokens of a whole text."""
    return sum(len(encoding.encode_ordinary(piece)) for piece in _pieces(text))


def language(c: Column) -> Column:
    """One of ``LANGUAGES``, else "other"."""
    low = F.substring(F.lower(F.trim(c)), 1, 2)
    return F.when(low.isin(*LANGUAGES), low).otherwise("other")


@dataclass(frozen=True)
class Plan:
    """Calibrated weight of every cell, and what the targets allow."""

    cells: list[tuple[str, str, str]]
    weights: list[float]
    total: float
    shares: dict[str, float]


def rake(cells: list[tuple[str, str, str]], tokens: np.ndarray, targets: dict[str, tuple[float, int]], total: float | None = None, rounds: int = 200) -> Plan:
    """Fit cell weights to the margins, the source margin last, under the caps.

    ``targets``: source -> (share, most repeats).  Without ``total`` the largest mixture is made
    that the caps allow at the exact shares (of the sources that have documents).
    """
    index = {s: np.array([k for k, c in enumerate(cells) if c[0] == s], dtype=int) for s in targets}
    held = {s: tokens[i].sum() for s, i in index.items()}
    there = {s: share for s, (share, most) in targets.items() if held[s] > 0 and share > 0 and most > 0}
    whole = sum(there.values())
    shares = {s: v / whole for s, v in there.items()}
    if not shares:
        return Plan(cells, [0.0] * len(cells), 0.0, {})
    most = min(targets[s][1] * held[s] / v for s, v in shares.items())
    total = min(total, most) if total is not None else most
    cap = np.array([targets[c[0]][1] if c[0] in shares else 0 for c in cells], dtype=float)
    weight = np.where(cap > 0, 1.0, 0.0)
    used = tokens * (cap > 0)
    margins = []
    for axis in (1, 2):
        for v in sorted({c[axis] for c in cells}):
            mine = np.array([k for k, c in enumerate(cells) if c[axis] == v], dtype=int)
            margins.append((mine, total * used[mine].sum() / used.sum()))
    for _ in range(rounds):
        before = weight.copy()
        for mine, goal in margins:
            now = (weight[mine] * tokens[mine]).sum()
            if now > 0:
                weight[mine] *= goal / now
        weight = np.minimum(weight, cap)
        for s, share in shares.items():
            mine, goal = index[s], total * share
            for _ in range(50):  # scale what is below the cap until the goal is met
                now = weight[mine] * tokens[mine]
                if abs(now.sum() - goal) <= 1e-9 * goal:
                    break
                free = mine[weight[mine] < cap[mine] * (1 - 1e-12)] if goal > now.sum() else mine
                if not len(free) or not (weight[free] * tokens[free]).sum():
                    break
                rest = goal - (now.sum() - (weight[free] * tokens[free]).sum())
                weight[free] = np.minimum(weight[free] * rest / (weight[free] * tokens[free]).sum(), cap[free])
        if np.max(np.abs(weight - before)) < 1e-9:
            break
    return Plan(cells, weight.tolist(), float(total), shares)


def sized(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, topics: int = 6) -> DataFrame:
    """``doc_id, source, language, tokens, topic`` of the documents that can be used; counts and sizes are stored, so texts are tokenised once."""
    wanted = targets.where(F.col("source").isNotNull()).select("source").distinct()
    slim = documents.where(F.length("text") > 0).join(wanted, "source", "left_semi").select("doc_id", "source", language(F.coalesce("lang", F.lit(""))).alias("language"), "text")
    counted = stored(count_tokens(slim, tokenizer=tokenizer, features=True).where("tokens > 0"), "counted")
    return stored(with_topics(counted, fit_topics(Stored(counted), topics)), "sizes")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> Plan:
    """Rake the cells; a few hundred sums (sources of the targets x languages x topics) reach the driver."""
    cells = sizes.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens")).orderBy("source", "language", "topic").collect()
    wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where(F.col("source").isNotNull()).collect()}
    return rake([(r.source, r.language, r.topic) for r in cells], np.array([r.tokens for r in cells], dtype=float), wanted, total_tokens)


def draw(sizes: DataFrame, made: Plan, salts: int = 64, seed: int = 11) -> DataFrame:
    """``doc_id, source, tokens, copies``: copies by calibrated weight, those above 0.

    A document's rank in its cell comes from counts of (cell, size class, salt) groups and
    its place in its group, so no cell is sorted as a whole; the fraction of the weight is
    then met by systematic sampling along the rank, in order of size class.
    """
    spark = sizes.sparkSession
    rows = [(*c, float(w)) for c, w in zip(made.cells, made.weights)]
    weights = spark.createDataFrame(rows, "source string, language string, topic string, weight double")
    cell = ["source", "language", "topic"]
    grouped = sizes.withColumn("_size", F.floor(F.log2("tokens") * 4)).withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(salts)))
    group = [*cell, "_size", "_salt"]
    before = Window.partitionBy(*cell).orderBy("_size", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grouped.groupBy(*group).count().withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id"))
    placed = grouped.withColumn("_in", rank).join(offsets, group).join(weights, cell)
    place, rest = F.col("_offset") + F.col("_in"), F.col("weight") - F.floor("weight")
    extra = F.floor(place * rest + 0.5) - F.floor((place - 1) * rest + 0.5)
    return (placed.withColumn("copies", (F.floor("weight") + extra).cast("int")).where("copies > 0")
            .select("doc_id", "source", "tokens", "copies"))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the mixture."""
    sizes = sized(documents, targets, tokenizer)
    return draw(sizes, plan(sizes, targets, total_tokens))


def goals(sizes: DataFrame, made: Plan) -> DataFrame:
    """``source, goal``: tokens that each source that can be used is to give."""
    rows = [(s, made.total * share) for s, share in made.shares.items()]
    return sizes.sparkSession.createDataFrame(rows, "source string, goal double")


def margins_reached(sizes: DataFrame, mixed: DataFrame) -> DataFrame:
    """``axis, value, corpus_share, actual_share`` of languages and topics: what they are raked to, and what came out."""
    both = sizes.join(mixed.select("doc_id", "copies"), "doc_id", "left")
    axis = F.explode(F.array(F.struct(F.lit("language").alias("axis"), F.col("language").alias("value")), F.struct(F.lit("topic").alias("axis"), F.col("topic").alias("value"))))
    sums = both.select(axis.alias("_a"), "tokens", (F.col("tokens") * F.coalesce("copies", F.lit(0))).alias("_used")).groupBy("_a.axis", "_a.value").agg(F.sum("tokens").alias("_held"), F.sum("_used").alias("_used"))
    whole = lambda c: F.sum(c).over(Window.partitionBy("axis"))
    return sums.select("axis", "value", (F.col("_held") / whole("_held")).alias("corpus_share"), F.try_divide(F.col("_used"), whole("_used")).alias("actual_share"))


def shares_reached(documents: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, documents, copies, tokens, actual_share, highest_copies`` per target source."""
    per = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").cast("bigint").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("highest_copies"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    whole = F.sum("tokens").over(Window.partitionBy())
    return (targets.join(per, "source", "left").select("source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("tokens"), zero("highest_copies"))
            .withColumn("actual_share", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0))))
