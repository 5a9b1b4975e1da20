"""Sentences of all documents: counts over the whole corpus, then each page cut by them.

The first pass counts, in every partition, what ``Tally`` keeps and adds the counts up by a shuffle of count rows; all of
them are summed by word, and the words of each kind make the model, which is all that comes to the driver. The second pass
brings each page into reading order again and judges its marks.

Defined results
---------------
* NULL and blank texts, pages of headlines and adverts only: no rows. NULL ids: no rows.
* Text behind the last mark of an article is a sentence if it holds a letter; it ends with its last letter.
* Very long texts are one page each, without limit of length. Repeated rows: repeated results.
* Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgrid.llm.checkpoints import shared_checkpoint
from kestrelgrid.llm.page_layout import PAGE_COLUMNS, LineKinds, pages_of
from kestrelgrid.llm.prose import articles
from kestrelgrid.llm.sentences import TOTALS, Model, Tally, ends, starter_kinds, word_kinds

#: Count rows kept in a worker before they are sent on.
_FLUSH = 400_000


def _pages(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())


def corpus_counts(documents: DataFrame, kinds: LineKinds | None) -> DataFrame:
    """(lang, kind, a, b, n) over all documents."""
    sent = documents.sparkSession.sparkContext.broadcast(kinds)
    names = ["lang", "kind", "a", "b", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

        tally = Tally()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                for page in pages_of(whole.slice(at, 500)):
                    for article in articles(*page, sent.value):
                        tally.add(article)
                if tally.size() > _FLUSH and (rows := tally.rows()):
                    yield out()
                    tally = Tally()
        if rows := tally.rows():
            yield out()

    counted = _pages(documents).select(*PAGE_COLUMNS).mapInArrow(count, "lang string, kind string, a string, b string, n bigint")
    return counted.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def word_totals(counts: DataFrame) -> DataFrame:
    """(lang, word, *TOTALS) of all count rows."""
    kind, thai = F.col("kind"), F.col("lang") == "th"
    first = F.when(kind == "pair", "pairs").when(kind == "next", "nexts").when((kind == "speaker") & ~thai, "first").when(kind == "clause", "any_first").otherwise(kind)
    second = F.when(kind == "pair", "behind").when((kind == "speaker") & ~thai, "last").when(kind == "clause", "any_last")
    rows = counts.select("lang", F.col("a").alias("word"), first.alias("what"), "n").unionByName(counts.select("lang", F.col("b").alias("word"), second.alias("what"), "n").where("what IS NOT NULL"))
    return rows.groupBy("lang", "word").agg(*[F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(k) for k in TOTALS])


def _judged(totals: DataFrame, judge: Callable[[str, str, dict[str, int]], Iterator[tuple[str, float]]]) -> DataFrame:
    """(lang, what, word, value) that ``judge`` says of the words."""
    names = ["lang", "what", "word", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c["lang"], what, c["word"], value) for c in batch.to_pylist() for what, value in judge(c["lang"], c["word"], c)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], names)

    return totals.mapInArrow(run, "lang string, what string, word string, value double")


def fit_model(documents: DataFrame, kinds: LineKinds | None) -> Model:
    """The model of all counts: totals of each word in Spark, starters first, as the other kinds ask what starters follow.

    Only the words of a kind, and the totals of each language, come to the driver.
    """
    counts = shared_checkpoint(corpus_counts(documents, kinds))
    totals = shared_checkpoint(word_totals(counts))
    all_of = {r.lang: r.asDict() | {"started": 0} for r in totals.groupBy("lang").agg(*[F.sum(k).alias(k) for k in TOTALS]).collect()}
    starters = shared_checkpoint(_judged(totals.where("start >= 3"), lambda lang, word, c: starter_kinds(word, c, all_of[lang])))
    known = {r.lang for r in starters.select("lang").distinct().collect()}
    after = counts.where("kind IN ('pair', 'next')").join(starters.where("what = 'starters'").select("lang", F.col("word").alias("b")), ["lang", "b"], "left_semi")
    started = after.groupBy("lang", F.col("a").alias("word")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_started") for k in ("pair", "next")])
    behind_marks = totals.join(starters.where("what = 'starters'").select("lang", "word"), ["lang", "word"], "left_semi").select("lang", F.col("start").alias("n"))
    for row in behind_marks.unionByName(started.select("lang", F.col("pair_started").alias("n"))).groupBy("lang").agg(F.sum("n").alias("n")).collect():
        all_of[row.lang]["started"] = row.n
    others = _judged(totals.join(started, ["lang", "word"], "left").fillna(0, ["pair_started", "next_started"]), lambda lang, word, c: word_kinds(lang, word, c, all_of[lang], lang in known))
    rows = starters.unionByName(others).toArrow()
    return Model.of(zip(*(rows.column(k).to_pylist() for k in ("lang", "what", "word", "value"))))


def split_sentences(documents: DataFrame, model: Model, kinds: LineKinds | None, *, with_text: bool = False) -> DataFrame:
    """(doc_id, end_pos) of every sentence; with_text adds lang and the sentence itself, line breaks as blanks."""
    sent = documents.sparkSession.sparkContext.broadcast((model, kinds))
    kind = dict(documents.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, line_kinds = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                index, places, langs, texts = [], [], [], []
                for k, page in enumerate(pages_of(batch)):
                    for article in articles(*page, line_kinds):
                        begin = 0
                        for end in ends(article, held):
                            index.append(k)
                            places.append(article.place(end - 1) + 1)
                            if with_text:
                                langs.append(article.lang)
                                texts.append(" ".join(article.text[begin:end].split()))
                                begin = end
                columns = [batch.column("doc_id").take(pa.array(index, pa.int64())), pa.array(places, pa.int32())]
                if with_text:
                    columns += [pa.array(langs, pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "end_pos", "lang", "sentence"][: len(columns)])

    return _pages(documents).select("doc_id", *PAGE_COLUMNS).mapInArrow(cut, f"doc_id {kind}, end_pos int" + ", lang string, sentence string" * with_text)
