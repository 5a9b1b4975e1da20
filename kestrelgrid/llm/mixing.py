"""Sources mixed to target weights by soft membership.

Every document has a posterior over the sources: certain where its source is named, predicted by a classifier fitted on
a bounded sample of labelled documents where it isn't. A document is taken at a rate r >= 0, at most as often as the
likeliest of its sources allows. The rates minimise the squared, relative miss of the expected token totals
T_s = sum r * p_s * tokens against the shares of the total B. Projected gradient steps are distributed: the gradient of a
document's rate is sum p_s * y_s with one number y_s for each mix and source, its projection onto 0 and the repeats is the
rate, and a step needs the totals reached only. The gradient is scaled by the inverse of the Gram matrix
sum p_s * p_t * tokens of the documents whose rate isn't cut off, so that one step meets all targets where none is, and a few
do where some are; a step that misses by more is halved. Steps end when the largest miss is below ``CLOSE``; what is missed
then is in the report.

B is the largest total at which every source that has documents can give its share from its own documents within its
repeats, unless the caller names one; sources that fall short are then taken as often as allowed, and the shares reached
are reported.

Rates become whole copies: the whole part for every document, and one more for those lowest by hash / fraction until the
source's expected tokens are reached, found by a histogram, a second one inside the bin of the cut, and an exact cut inside
one of its bins, a four-millionth of a source.

Defined results
---------------
* NULL and empty texts: no tokens, never taken. NULL sources: by posterior. Named sources without a target: never taken.
  Sources are compared in lower case, without spaces around, blanks and underscores as hyphens.
* Targets with NULL or non-positive shares or repeats: share 0. A source without documents: reported with 0 reached.
* Repeated rows of a document count once. Empty tables: no rows (a report of zeros where there are targets).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgrid.llm.checkpoints import shared_checkpoint
from kestrelgrid.llm.tokenizing import TOKENIZERS, count_tokens

#: Steps at most, the relative miss that ends them, bins of a histogram, and the least share of a membership.
STEPS, CLOSE, BINS, LEAST_PART = 100, 1e-6, 4096, 1e-9
#: Part of the whole Gram matrix that is kept in a step, so that a source whose rates are all cut off can still come back.
_KEPT = 1e-6


def source_name(source: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(F.lower(source)), r"[ _]+", "-"), F.lit(""))


class SourceClassifier:
    """Naive Bayes on words of a page, its first line twice, hashed into ``DIMENSIONS`` columns."""

    DIMENSIONS = 1 << 15

    def __init__(self, labelled: list[tuple[str, str]]) -> None:
        self.names = sorted({s for s, _ in labelled})
        number = {s: k for k, s in enumerate(self.names)}
        counts = np.full((len(self.names), self.DIMENSIONS), 0.05, np.float32)
        prior = np.ones(len(self.names))
        for source, text in labelled:
            prior[number[source]] += 1
            for column, n in self._columns(text).items():
                counts[number[source], column] += n
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True)) if self.names else counts
        self.prior = np.log(prior / prior.sum()) if self.names else prior

    def _columns(self, text: str) -> Counter:
        found = (text.split("\n", 1)[0] * 2 + " " + text).lower().split()
        return Counter(hash_of(w) % self.DIMENSIONS for w in found)

    def posterior(self, text: str) -> list[tuple[str, float]]:
        """All sources of a share above ``LEAST_PART``; the evidence is damped by the root of its length, as words aren't independent."""
        if not self.names:
            return []
        columns = self._columns(text)
        keys, n = np.fromiter(columns, np.int64, len(columns)), np.fromiter(columns.values(), np.float64, len(columns))
        score = (self.prior + self.logs[:, keys] @ n) / math.sqrt(max(1.0, n.sum()))
        weight = np.exp(score - score.max())
        share = weight / weight.sum()
        return [(self.names[k], float(share[k])) for k in np.argsort(-share, kind="stable") if share[k] >= LEAST_PART]


def hash_of(word: str) -> int:
    """A hash of a word that is alike in all processes."""
    out = 2166136261
    for byte in word.encode():
        out = (out ^ byte) * 16777619 & 0xFFFFFFFF
    return out


def fit_classifier(documents: DataFrame, rows: int = 4000) -> SourceClassifier:
    """Fitted on the ``rows`` labelled documents whose ids hash lowest; no more come to the driver."""
    labelled = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & source_name(F.col("source")).isNotNull())
    ids = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = labelled.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", source_name(F.col("source")).alias("source"), "text").toPandas()
    sample = sample.drop_duplicates("doc_id").sort_values("doc_id")
    return SourceClassifier(list(zip(sample["source"], sample["text"])))


def sized_members(documents: DataFrame, classifier: SourceClassifier | None, *, folder: str = TOKENIZERS, tokenizer: str = "byte_bpe_multi_50k") -> DataFrame:
    """(doc_id, tokens, member map<source, share>, u): u in [0, 1) by hash. Documents without tokens are left out."""
    sent = documents.sparkSession.sparkContext.broadcast(classifier)
    kept = documents.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select("doc_id", source_name(F.col("source")).alias("source"), "text")
    kind = dict(documents.dtypes)["doc_id"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sources = batch.column("text").to_pylist(), batch.column("source").to_pylist()
            members = [[(s, 1.0)] if s is not None else sent.value.posterior(t) if sent.value else [] for s, t in zip(sources, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count_tokens(texts, folder, tokenizer), pa.int64()), pa.array(members, pa.map_(pa.string(), pa.float64()))], ["doc_id", "tokens", "member"])

    sized = kept.mapInArrow(measure, f"doc_id {kind}, tokens bigint, member map<string,double>")
    one = sized.where("tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"), F.first("member").alias("member"))
    return one.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40)))


class _Mix:
    """Targets of one mix, the totals to meet and the steps taken so far.

    ``gram`` is the matrix of sum p_s * p_t * tokens over the documents that may be taken; ``own`` the tokens of each source
    in documents of which it is the likeliest.
    """

    def __init__(self, name: str, targets: dict[str, tuple[float, int]]) -> None:
        self.name, self.targets = name, {s: (w, c) for s, (w, c) in targets.items() if w and w > 0 and c and c > 0}
        self.sources = sorted(self.targets)
        self.number = {s: k for k, s in enumerate(self.sources)}
        self.goal = np.zeros(len(self.sources))
        self.gram = np.zeros((len(self.sources),) * 2)
        self.y = self.best = self.move = np.zeros(len(self.sources))
        self.far, self.miss, self.steps = math.inf, math.inf, 0

    def aim(self, own: np.ndarray, gram: np.ndarray, total: float | None) -> None:
        share, cap = (np.array([self.targets[s][k] for s in self.sources]) for k in (0, 1))
        room = (cap * own / share)[own > 0] if len(own) else own
        self.total = total if total is not None else float(room.min()) if len(room) else 0.0
        self.goal, self.gram = np.minimum(share * self.total, cap * own), gram

    def step(self, reached: np.ndarray, free: np.ndarray) -> bool:
        """Judges the totals reached with ``y`` and moves it where the miss isn't small; whether it did. ``free`` is the Gram matrix of the documents whose rate isn't cut off."""
        short = self.goal - reached
        far = float(np.linalg.norm(short / np.maximum(self.goal, 1.0)))
        if far < self.far:
            self.best, self.far = self.y, far
            self.miss = float((np.abs(short) / np.maximum(self.goal, 1.0)).max()) if len(short) else 0.0
            self.move = np.linalg.lstsq(free + _KEPT * self.gram, short, rcond=1e-12)[0]
        else:
            self.move = self.move / 2
        if self.miss <= CLOSE:
            self.y = self.best
            return False
        self.y, self.steps = self.best + self.move, self.steps + 1
        return True

    def member(self, member: list[tuple[str, float]]) -> tuple[np.ndarray, int]:
        """Shares of the mix's sources in a document, and how often it may be taken."""
        own = max(member, key=lambda x: (x[1], x[0]))[0] if member else None
        share = np.zeros(len(self.sources))
        for s, p in member:
            if s in self.number:
                share[self.number[s]] = p
        return share, self.targets.get(own, (0, 0))[1]

    def rate(self, share: np.ndarray, limit: int) -> float:
        return min(limit, max(0.0, float(share @ self.y))) if limit else 0.0


def _placed(mix: _Mix, members: list[list[tuple[str, float]]]) -> list[tuple[np.ndarray, int, float]]:
    """(shares, limit, rate) by document; documents of one certain source have theirs in common."""
    certain: dict[str, tuple[np.ndarray, int, float]] = {}
    out = []
    for member in members:
        if len(member) == 1 and member[0][1] == 1.0:
            source = member[0][0]
            if source not in certain:
                share, limit = mix.member(member)
                certain[source] = (share, limit, mix.rate(share, limit))
            out.append(certain[source])
        else:
            share, limit = mix.member(member)
            out.append((share, limit, mix.rate(share, limit)))
    return out


def _summed(sized: DataFrame, mixes: list[_Mix], terms) -> list[np.ndarray]:
    """For each mix the sum over all documents of ``terms(mix, shares, limits, rates, tokens)``, an array; added up by place in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list = [None] * len(mixes)
        for batch in batches:
            members, tokens = batch.column("member").to_pylist(), batch.column("tokens").to_numpy().astype(np.float64)
            for k, mix in enumerate(mixes):
                placed = _placed(mix, members)
                if placed and mix.sources:
                    found = terms(mix, np.stack([p[0] for p in placed]), np.array([p[1] for p in placed]), np.array([p[2] for p in placed]), tokens)
                    sums[k] = found if sums[k] is None else sums[k] + found
        for k, total in enumerate(sums):
            if total is not None:
                flat = total.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["mix", "place", "n"])

    out = sized.select("tokens", "member").mapInArrow(run, "mix int, place int, n double").groupBy("mix", "place").agg(F.sum("n").alias("n"))
    sums: list = [{} for _ in mixes]
    for row in out.collect():  # numbers for each mix and source, or pair of sources
        sums[row.mix][row.place] = row.n
    return [np.array([s[k] for k in sorted(s)]) for s in sums]


def solve_rates(sized: DataFrame, mixes: list[_Mix], total: float | None = None) -> None:
    """Sets the goals, then takes steps until every mix is met or ``STEPS`` are taken."""

    def matter(mix: _Mix, share, limit, rate, tokens) -> np.ndarray:
        own = share.argmax(axis=1)
        mine = np.bincount(own[limit > 0], (share[np.arange(len(own)), own] * tokens)[limit > 0], minlength=len(mix.sources))
        taken = share[limit > 0]
        return np.vstack([mine, taken.T @ (taken * tokens[limit > 0, None])])

    def reach(mix: _Mix, share, limit, rate, tokens) -> np.ndarray:
        free = (rate > 0) & (rate < limit)
        return np.vstack([(rate * tokens) @ share, share[free].T @ (share[free] * tokens[free, None])])

    for mix, found in zip(mixes, _summed(sized, mixes, matter)):
        held = found.reshape(-1, len(mix.sources)) if len(found) else np.zeros((len(mix.sources) + 1, len(mix.sources)))
        mix.aim(held[0] if len(held) else np.zeros(0), held[1:], total)
    stand = [np.vstack([np.zeros(len(mix.sources)), mix.gram]) for mix in mixes]
    for _ in range(STEPS):
        if not any([mix.step(now[0], now[1:]) for mix, now in zip(mixes, stand)]):
            break
        stand = [found.reshape(-1, len(mix.sources)) if len(found) else now for mix, now, found in zip(mixes, stand, _summed(sized, mixes, reach))]
    for mix in mixes:
        mix.y = mix.best


def mix_sources(documents: DataFrame, targets: DataFrame, classifier: SourceClassifier | None, *, total_tokens: float | None = None, folder: str = TOKENIZERS, tokenizer: str = "byte_bpe_multi_50k") -> tuple[DataFrame, DataFrame]:
    """documents: (doc_id, source, text); targets: (mix_name, source, target_share, max_repeats).

    Results: (mix_name, doc_id, source, tokens, copies) of the documents taken, and a report (mix_name, source,
    target_share, reached_share, tokens, documents, copies, max_repeats, miss) with a row for each target; ``miss`` is the
    largest relative miss of the expected totals of the mix when the steps ended.
    """
    spark = documents.sparkSession
    sized = shared_checkpoint(sized_members(documents, classifier, folder=folder, tokenizer=tokenizer))
    wanted = targets.where(F.col("mix_name").isNotNull()).groupBy("mix_name", source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))
    named = wanted.where(F.col("source").isNotNull())
    by_mix: dict[str, dict[str, tuple[float, int]]] = {}
    for row in named.collect():  # the targets are the operator's parameters
        by_mix.setdefault(row.mix_name, {})[row.source] = (row.target_share, row.max_repeats)
    mixes = [_Mix(name, wants) for name, wants in sorted(by_mix.items())]
    solve_rates(sized, mixes, total_tokens)
    missed = spark.createDataFrame([(mix.name, mix.miss) for mix in mixes], "mix_name string, miss double")
    taken = _whole_copies(_with_rates(sized, mixes))
    reached = taken.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    whole = reached.groupBy("mix_name").agg(F.sum("tokens").alias("all_tokens"))
    report = (
        named.join(reached, ["mix_name", "source"], "left").join(whole, "mix_name", "left").join(missed, "mix_name", "left").fillna(0, ["tokens", "documents", "copies"])
        .select("mix_name", "source", "target_share", F.coalesce(F.round(F.col("tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("reached_share"), "tokens", "documents", "copies", "max_repeats", F.round("miss", 9).alias("miss"))
    )
    return taken, report


def _with_rates(sized: DataFrame, mixes: list[_Mix]) -> DataFrame:
    """(mix_name, doc_id, source, tokens, u, whole int, part double, cap int) of the documents with a rate above 0."""
    kind = dict(sized.dtypes)["doc_id"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("member").to_pylist()
            owners = [max(m, key=lambda x: (x[1], x[0]))[0] if m else None for m in members]
            for mix in mixes:
                rates = [(rate, limit) for _, limit, rate in _placed(mix, members)]
                index = [k for k, (r, _) in enumerate(rates) if r > 0]
                kept = batch.take(pa.array(index, pa.int64()))
                whole = [math.floor(rates[k][0] + 1e-9) for k in index]
                part = [max(0.0, rates[k][0] - w) for k, w in zip(index, whole)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([mix.name] * len(index), pa.string()), kept.column("doc_id"), pa.array([owners[k] for k in index], pa.string()), kept.column("tokens"), kept.column("u"), pa.array(whole, pa.int32()), pa.array(part, pa.float64()), pa.array([rates[k][1] for k in index], pa.int32())],
                    ["mix_name", "doc_id", "source", "tokens", "u", "whole", "part", "cap"],
                )

    return sized.select("doc_id", "tokens", "member", "u").mapInArrow(rate, f"mix_name string, doc_id {kind}, source string, tokens bigint, u double, whole int, part double, cap int")


def _whole_copies(rated: DataFrame) -> DataFrame:
    """One copy more for the documents lowest by u / part, until the tokens of the parts are made up."""
    of = ["mix_name", "source"]
    due = rated.groupBy(*of).agg(F.sum(F.col("part") * F.col("tokens")).alias("due"))
    v = F.when(F.col("part") > 0, F.col("u") / F.col("part"))
    first = F.least(F.floor(F.col("v") * (BINS // 4)), F.lit(BINS)).cast("int")
    second = F.least(F.floor((F.col("v") * (BINS // 4) - F.col("bin")) * BINS), F.lit(BINS)).cast("int")
    placed = rated.withColumn("v", v).withColumn("bin", first).withColumn("sub", second)
    # whole bins below the cut, none above; inside the bin of the cut the same by its own bins, and inside the one of these documents are put in order
    cut, before = _bin_of_cut(placed.where("bin IS NOT NULL"), of, "bin", due.withColumn("before", F.lit(0.0)))
    within = placed.join(cut, [*of, "bin"], "left_semi")
    sub_cut, sub_before = _bin_of_cut(within, of, "sub", due.join(before, of))
    inside = within.join(sub_cut, [*of, "sub"], "left_semi").join(due, of).join(sub_before, of)
    order = Window.partitionBy(*of, "sub").orderBy("v", "doc_id")
    exact = inside.select("mix_name", "doc_id", (F.col("before") + F.sum("tokens").over(order) - F.col("tokens") / 2 <= F.col("due")).alias("more"))
    edges = cut.withColumnRenamed("bin", "cut").join(sub_cut.withColumnRenamed("sub", "sub_cut"), of, "left")
    rows = placed.join(edges, of, "left").join(exact, ["mix_name", "doc_id"], "left")
    below = F.coalesce(F.col("bin") < F.col("cut"), F.lit(True)) | ((F.col("bin") == F.col("cut")) & F.coalesce(F.col("sub") < F.col("sub_cut"), F.lit(True)))
    extra = F.coalesce("more", below)
    copies = F.col("whole") + F.when(F.col("bin").isNotNull() & extra & (F.col("whole") < F.col("cap")), 1).otherwise(0)
    return rows.select("mix_name", "doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def _bin_of_cut(rows: DataFrame, of: list[str], name: str, due: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of, name) of the bin in which the tokens due are reached, none where all bins together don't, and (of, before): the tokens of the bins below it."""
    n = rows.groupBy(*of, name).agg(F.sum("tokens").alias("n")).join(due, of)
    upto = n.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*of).orderBy(name)))
    cut = upto.where(F.col("upto") > F.col("due")).groupBy(*of).agg(F.min(F.struct(name, (F.col("upto") - F.col("n")).alias("before"))).alias("c"))
    return cut.select(*of, f"c.{name}"), cut.select(*of, "c.before")
