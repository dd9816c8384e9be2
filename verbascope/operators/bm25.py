"""BM25 over any tokeniser, by language: postings, statistics, scores, and rankings of fixed depth."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import NUDGE, rounded
from ..functions.text import python_tokeniser
from ..plans.materialise import counted_side, materialise, passing_folder
from .best import Best

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Places to which scores are rounded before they are ranked, so that ties are ties whatever the order of summing.
PLACES = 6
#: Distinct query terms of one block, about: what every task knows by name.
BLOCK_TERMS = 400_000
#: Queries of one task at most, about, and at least where a language has more tasks than one.
TASK_QUERIES, LEAST_QUERIES = 4_000, 250
#: Documents, and tokens, of one chunk, and distinct words that a task remembers the terms of, a language.
CHUNK_DOCUMENTS, CHUNK_TOKENS, KEPT_WORDS = 2_000, 500_000, 100_000
#: Scores of documents and queries that a task computes at a time, and products it adds up for them at a time.
BATCH_SCORES, BATCH_PRODUCTS = 2_000_000, 2_000_000
#: Cells of the matrix of common terms and queries at most, and the share of pairs of document and query that must have a term in common for it to be there.
MATRIX_CELLS, DENSE_SHARE = 8_000_000, 0.002
#: Distinct terms that a task counts before it hands the counts on, and terms of one row of counts.
COUNTED_TERMS, ROW_TERMS = 500_000, 2_000


def postings(corpus: DataFrame, tokens: Column) -> DataFrame:
    """(lang, docid, term, tf) of a corpus with one row a document; documents without tokens have none.

    A corpus that is already partitioned by language and docid is not shuffled again.
    """
    return corpus.select("lang", "docid", F.explode(tokens).alias("term")).groupBy("lang", "docid", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(corpus: DataFrame, tokens: Column) -> DataFrame:
    """(lang, docid, length) with the number of tokens of every document, repeated ones too."""
    return corpus.select("lang", "docid", F.size(tokens).cast("bigint").alias("length"))


def collection_statistics(length: DataFrame) -> DataFrame:
    """(lang, n_docs, mean_length), empty documents included."""
    return length.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))


def inverse_frequencies(posting: DataFrame, statistics: DataFrame, few: bool = False) -> DataFrame:
    """(lang, term, df, idf); a negative idf becomes a quarter of the mean raw idf of the language's terms.

    `few` says that counting has shown few languages, so that a row a language may be broadcast.
    """
    return inverse_from(posting.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df")), statistics, few)


def inverse_from(frequencies: DataFrame, statistics: DataFrame, few: bool = False) -> DataFrame:
    """As `inverse_frequencies`, of counted (lang, term, df)."""
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    counted = frequencies.join(statistics.select("lang", "n_docs"), "lang").withColumn("raw", raw)
    mean = counted.groupBy("lang").agg(F.avg("raw").alias("mean_raw"))
    idf = F.when(F.col("raw") < 0, FLOOR * F.col("mean_raw")).otherwise(F.col("raw"))
    return counted.join(F.broadcast(mean) if few else mean, "lang").select("lang", "term", "df", idf.alias("idf"))


def query_terms(topics: DataFrame, tokens: Column) -> DataFrame:
    """(lang, qid, term, qtf): a term that a query repeats counts as often."""
    return topics.select("lang", "qid", F.explode(tokens).alias("term")).groupBy("lang", "qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def scored(corpus: DataFrame, topics: DataFrame, corpus_tokens: Column, topic_tokens: Column) -> DataFrame:
    """(lang, qid, docid, score) of every document that shares a term with a query of its language.

    Only postings of terms that some query has meet the queries; documents without a common term score 0 and are left out.
    """
    posting, length = postings(corpus, corpus_tokens), lengths(corpus, corpus_tokens)
    statistics, few = counted_side(collection_statistics(length))
    asked = query_terms(topics, topic_tokens)
    weights = asked.join(inverse_frequencies(posting, statistics, few), ["lang", "term"]).select("lang", "term", "qid", (F.col("idf") * F.col("qtf")).alias("weight"))
    scale = K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    matched = posting.join(asked.select("lang", "term").distinct(), ["lang", "term"], "left_semi").join(length, ["lang", "docid"]).join(statistics.select("lang", "mean_length"), "lang")
    impact = matched.select("lang", "term", "docid", (F.col("tf") * (K1 + 1) / (F.col("tf") + scale)).alias("impact"))
    hits = impact.join(weights, ["lang", "term"])
    return hits.groupBy("lang", "qid", "docid").agg(rounded(F.sum(F.col("weight") * F.col("impact")), PLACES).alias("score"))


def ranked(scores: DataFrame, depth: int) -> DataFrame:
    """(lang, qid, docid, score, rank): the best `depth` documents a query, ties by docid."""
    order = Window.partitionBy("lang", "qid").orderBy(F.desc("score"), "docid")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def padded(top: DataFrame, topics: DataFrame, corpus: DataFrame, depth: int) -> DataFrame:
    """`top` filled to `depth` documents a query with documents that share no term, in docid order, of score 0.

    A query that is short has all its hits in `top`, so the first `depth` docids of its language are enough for
    it, and the padding is of bounded size. Scores below 0 do not occur with a floored idf unless most terms are everywhere.
    """
    first = Window.partitionBy("lang").orderBy("docid")
    pads = corpus.select("lang", "docid").withColumn("place", F.row_number().over(first)).where(F.col("place") <= depth).select("lang", "docid")
    short = topics.select("lang", "qid").join(top.groupBy("lang", "qid").agg(F.count(F.lit(1)).alias("n")), ["lang", "qid"], "left").where(F.coalesce("n", F.lit(0)) < depth).select("lang", "qid")
    extra = short.join(pads, "lang").join(top.select("lang", "qid", "docid"), ["lang", "qid", "docid"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(top.select("lang", "qid", "docid", "score").unionByName(extra), depth)


def _splitter(tokeniser: str | None):
    """The tokeniser of each language: the one named, or else the one named before the `/` of the language."""
    from functools import lru_cache

    return lru_cache(maxsize=None)(lambda lang: python_tokeniser(tokeniser or lang.partition("/")[0]))


def run_bm25(corpus: DataFrame, topics: DataFrame, tokeniser: str | None = "char4", depth: int = 100, pad: bool = True) -> DataFrame:
    """(lang, qid, docid, score, rank): the best `depth` documents of each query's language, those of score 0 in docid order.

    corpus: (lang, docid, norm), one row a document; topics: (lang, qid, norm). Each document is tokenised once,
    into the numbers of those of its terms that some query has, and written to the shared folder by language; the
    same pass counts in how many documents every term occurs. A task then reads the documents of one language for
    a part of its queries, so that rankings are whole when they leave it: neither postings, pairs of query and
    document nor candidates are shuffled. More than about BLOCK_TERMS distinct terms make further blocks of
    queries, each with a pass of its own. Without `pad`, documents of score 0 have no rows. Without `tokeniser`,
    languages are named `tokeniser/language`, so that several tokenisers share a run.
    Null texts are empty; empty queries rank all documents at 0; languages without documents have no rows.
    """
    asked = materialise(_query_terms(topics, tokeniser))
    sizes = {r.lang: r.n for r in asked.where("term is null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_blocks = max(1, -(-asked.where("term is not null").select("lang", "term").distinct().count() // BLOCK_TERMS))
    block_of = F.pmod(F.xxhash64("lang", "qid"), F.lit(n_blocks))
    result = None
    for block in range(n_blocks):  # the number of blocks follows the stated query set
        own = asked.where(block_of == block)
        numbers: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
        for lang, term in zip(*(c.to_pylist() for c in own.where("term is not null").select("lang", "term").distinct().toArrow().columns)):
            numbers[lang][term] = len(numbers[lang])
        folder = passing_folder(corpus.sparkSession, "bm25")
        _encoded(corpus, numbers, tokeniser, count=block == 0).write.partitionBy("language").parquet(folder)
        if block == 0:
            encoded = corpus.sparkSession.read.schema(f"{ENCODED}, language int").parquet(folder)
            sums = encoded.where("language >= 0").groupBy("lang").agg(F.sum("n_docs").alias("n_docs"), (F.sum("length") / F.sum("n_docs")).alias("mean_length"))
            statistics, few = counted_side(sums)
            each = encoded.where("language < 0").select("lang", F.explode(F.arrays_zip(F.col("terms"), F.col("counts"))).alias("e"))
            frequencies = each.groupBy("lang", F.col("e.terms").alias("term")).agg(F.sum("e.counts").alias("df"))
            there = {r.lang: (r.n_docs, r.mean_length) for r in statistics.collect()}
            vocabulary = materialise(inverse_from(frequencies, statistics, few)) if n_blocks > 1 else inverse_from(frequencies, statistics, few)
        weights = own.join(vocabulary, ["lang", "term"]).select("lang", "qid", "term", (F.col("idf") * F.col("qtf")).alias("weight"), "df")
        every = weights.unionByName(own.where("term is null").select("lang", "qid", "term", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("bigint").alias("df")))
        part = materialise(_rankings(every, folder, numbers, sizes, there, depth, pad))  # else a caller's sort would score twice
        result = part if result is None else result.unionByName(part)
    return result


def _query_terms(topics: DataFrame, tokeniser: str | None) -> DataFrame:
    """(lang, qid, term, qtf): a term that a query repeats counts as often. Each query has a row with a null term besides."""

    def batches(source):
        from collections import Counter

        import pyarrow as pa

        split = _splitter(tokeniser)
        for batch in source:
            rows = [(lang, qid, t, n) for lang, qid, norm in zip(*(c.to_pylist() for c in batch.columns)) for t, n in [(None, 0), *Counter(split(lang)(norm or "")).items()]]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["lang", "qid", "term", "qtf"])

    there = topics.where("lang is not null and qid is not null").select("lang", "qid", "norm")
    there = there.repartition(4 * topics.sparkSession.sparkContext.defaultParallelism, "lang", "qid")  # few bytes, much work a row
    return there.mapInArrow(batches, "lang string, qid string, term string, qtf bigint")


#: Columns of encoded documents.
ENCODED = "lang string, n_docs bigint, length bigint, docids binary, entries binary, terms array<string>, counts array<int>"


def _encoded(corpus: DataFrame, numbers: dict, tokeniser: str | None, count: bool) -> DataFrame:
    """Documents of the queries' languages in chunks of one language, numbered as in `numbers`: (language, *ENCODED).

    docids and entries are serialised Arrow batches of as many rows as the chunk has documents: (docid), and
    (length, terms' numbers, counts). With `count`, rows of language -1 say in how many of a task's documents each
    term occurs (lang, terms, counts).
    """
    shared = corpus.sparkSession.sparkContext.broadcast(numbers)

    def batches(source):
        import pyarrow as pa

        known, split = shared.value, _splitter(tokeniser)
        own: dict[str, _Documents] = {}
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
        names = ["language", "lang", "n_docs", "length", "docids", "entries", "terms", "counts"]
        place = {lang: i for i, lang in enumerate(known)}

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names=names)

        def chunk(lang, last=False):
            if own[lang].docids:
                yield row(place[lang], lang, *own[lang].chunk(pa), None, None)
            if last or len(own[lang].terms) > COUNTED_TERMS:
                for terms, counts in own[lang].counted() if count else ():
                    yield row(-1, lang, None, None, None, None, terms, counts)
                del own[lang]

        for batch in source:
            for lang, docid, norm in zip(*(c.to_pylist() for c in batch.columns)):
                if lang in known:
                    if lang not in own:
                        own[lang] = _Documents(known[lang], split(lang))
                    own[lang].add(docid, norm or "")
                    if len(own[lang].docids) >= CHUNK_DOCUMENTS or len(own[lang].tokens) > CHUNK_TOKENS:
                        yield from chunk(lang)
        for lang in list(own):
            yield from chunk(lang, last=True)

    there = corpus.where("lang is not null and docid is not null").select("lang", "docid", "norm")
    return there.mapInArrow(batches, f"language int, {ENCODED}")


class _Documents:
    """Documents of one language, terms as numbers in the order in which they first occur; each distinct word is taken apart once."""

    def __init__(self, known: dict, split):
        import numpy as np

        self.known, self.split = known, split
        self.terms: dict[str, int] = {}
        self.words: dict[str, tuple] = {}
        self.numbers: list[int] = []  # of each term, that which queries know it by, or -1
        self.df = np.zeros(0, np.int64)
        self.docids, self.lengths, self.tokens = [], [], []

    def add(self, docid: str, norm: str) -> None:
        before = len(self.tokens)
        for word in norm.split():
            self.tokens += self.words.get(word) or self._word(word)
        self.docids.append(docid)
        self.lengths.append(len(self.tokens) - before)

    def _word(self, word: str) -> tuple:
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        found = []
        for t in self.split(word):
            if (k := self.terms.get(t)) is None:
                k = self.terms[t] = len(self.terms)
                self.numbers.append(self.known.get(t, -1))
            found.append(k)
        own = self.words[word] = tuple(found)
        return own

    def chunk(self, pa):
        """(number of documents, their length, docids, entries) of the documents added since the last."""
        import numpy as np

        n, width = len(self.docids), max(1, len(self.terms))
        cells = np.repeat(np.arange(n), self.lengths) * width + np.array(self.tokens, np.int64)
        cells, counts = np.unique(cells, return_counts=True)
        document, term = np.divmod(cells, width)
        df = np.bincount(term, minlength=width)
        df[: len(self.df)] += self.df
        self.df = df
        number = np.array([*self.numbers, -1], np.int32)[term]
        kept = number >= 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(document[kept], minlength=n))])
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[kept].astype(np.int32)))
        first = _packed(pa.RecordBatch.from_arrays([pa.array(self.docids, pa.string())], names=["docid"]))
        second = _packed(pa.RecordBatch.from_arrays([pa.array(self.lengths, pa.int64()), lists(number), lists(counts)], names=["length", "numbers", "counts"]))
        length = sum(self.lengths)
        self.docids, self.lengths, self.tokens = [], [], []
        return n, length, first, second

    def counted(self):
        """(terms, in how many documents each was), in pieces."""
        every, df = list(self.terms), self.df.tolist()
        for i in range(0, len(every), ROW_TERMS):
            yield every[i : i + ROW_TERMS], df[i : i + ROW_TERMS]


def _packed(batch) -> bytes:
    """An Arrow batch as bytes."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _chunks(folder: str, language: int, column: str):
    """The Arrow batches in a column of a language's encoded documents, in the same order every time."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    own = files.get_file_info(fs.FileSelector(f"{path}/language={language}", allow_not_found=True))
    for info in sorted(own, key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as file:
                for rows in pq.ParquetFile(file).iter_batches(batch_size=8, columns=[column]):
                    for packed in rows.column(0):
                        yield pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def _rankings(weights: DataFrame, folder: str, numbers: dict, sizes: dict, there: dict, depth: int, pad: bool) -> DataFrame:
    """(lang, qid, docid, score, rank) of weighted queries (lang, qid, term, weight, df), a row with a null term each, over the documents in `folder`.

    A task has part of the queries of one language, by the work they make and at most about TASK_QUERIES.
    """
    session = weights.sparkSession
    work = {lang: n * there[lang][0] for lang, n in sizes.items() if lang in there}
    share = 4 * session.sparkContext.defaultParallelism / max(1, sum(work.values()))
    parts = {lang: max(-(-sizes[lang] // TASK_QUERIES), min(math.ceil(w * share), -(-sizes[lang] // LEAST_QUERIES))) for lang, w in work.items()}
    starts = dict(zip(parts, accumulate(parts.values(), initial=0)))
    tasks = session.createDataFrame([(lang, starts[lang], n) for lang, n in parts.items()], "lang string, first int, parts int")
    own = weights.join(F.broadcast(tasks), "lang").withColumn("task", (F.col("first") + F.pmod(F.xxhash64("qid"), F.col("parts"))).cast("int"))
    own = own.select("lang", "qid", "term", "weight", "df", "task").repartitionById(max(1, sum(parts.values())), F.col("task"))
    shared = session.sparkContext.broadcast((numbers, there))

    def batches(source):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = [b for b in source if b.num_rows]
        every = pa.Table.from_batches(rows) if rows else None
        known, statistics = shared.value
        for lang in every.column("lang").unique().to_pylist() if every else ():
            asked = every.filter(pc.equal(every.column("lang"), lang))
            n_docs, mean_length = statistics[lang]
            queries, local = _weighted(asked, known[lang], n_docs, mean_length, depth)
            language = list(known).index(lang)
            docids = pa.chunked_array([b.column(0) for b in _chunks(folder, language, "docids")]).combine_chunks()
            places = np.empty(len(docids), np.int64)
            order = pc.array_sort_indices(docids).to_numpy()
            places[order] = np.arange(len(docids))
            at = 0
            for batch in _chunks(folder, language, "entries"):
                lengths = batch.column(0).to_numpy(zero_copy_only=False)
                term, counts, ends = local[batch.column(1).values.to_numpy()], batch.column(2).values.to_numpy(), batch.column(1).offsets.to_numpy()
                kept = np.concatenate([[0], np.cumsum(term >= 0)])
                queries.add((), lengths, term[term >= 0], counts[term >= 0], kept[ends], places[at : at + len(lengths)])
                at += len(lengths)
            yield from queries.rows(lang, docids, order, pad, pa)

    return own.mapInArrow(batches, "lang string, qid string, docid string, score double, rank int")


def _weighted(asked, numbers: dict, n_docs: int, mean_length: float, depth: int):
    """Queries of one language from rows (qid, term, weight, df), and by the number of a term its place among their terms, else -1."""
    import numpy as np
    import pyarrow.compute as pc

    qid, term = (asked.column(c).combine_chunks().dictionary_encode() for c in ("qid", "term"))
    has = asked.column("term").is_valid().to_numpy()
    queries, terms = qid.indices.to_numpy()[has], pc.fill_null(term.indices, -1).to_numpy()[has]
    weights, df = (pc.fill_null(asked.column(c), 0).to_numpy()[has] for c in ("weight", "df"))
    order = np.argsort(terms, kind="stable")
    names = term.dictionary.to_pylist()
    starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(names)))]).astype(np.int64)
    often = np.zeros(len(names))
    often[terms] = df / n_docs
    local = np.full(max(1, len(numbers)), -1, np.int64)
    local[[numbers[t] for t in names]] = np.arange(len(names))
    return _Queries(qid.dictionary.to_pylist(), starts, queries[order].astype(np.int64), weights[order], mean_length, depth, often), local


class _Queries:
    """Weighted queries of one language, terms leading to queries, and the best documents seen so far.

    Scores are first summed in single precision, for all queries at once; where they come near what a query's best
    documents have, by more than the error that such a sum can have, they are summed again in double precision.
    """

    def __init__(self, qids: list[str], starts, queries, weights, mean_length: float, depth: int, share=None):
        """share: by term, the share of documents that have it, where it is known; it decides how a term is multiplied, no score."""
        import numpy as np

        n = max(1, len(qids))
        self.qids, self.starts, self.queries, self.weights, self.mean_length, self.depth = qids, starts, queries, weights, mean_length, depth
        # Where a weight is below 0, documents of score 0 may stand above others, so all are ranked here, and errors are no share of a score.
        self.whole = bool((weights < 0).any())
        self.kind = np.float64 if self.whole else np.float32
        self.best = Best(len(qids), depth, float("-inf") if self.whole else 0.5 * 10.0**-PLACES)
        self.docids: list[str] = []
        self.seen = 0
        often = np.diff(starts)
        self.n_terms = len(often)
        # Terms by which many products arise are multiplied as a matrix, of bounded size, the others one by one.
        products = often.astype(float) if share is None else often * share
        common = np.flatnonzero(often > max(8, n // 32) if share is None else products > DENSE_SHARE * n)
        common = common[np.argsort(-products[common], kind="stable")][: max(1, MATRIX_CELLS // n)]
        self.column = np.full(self.n_terms, -1)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(qids)), self.kind)
        for k, t in enumerate(common):
            np.add.at(self.matrix[k], queries[starts[t] : starts[t + 1]], weights[starts[t] : starts[t + 1]])
        # The same by query.
        order = np.argsort(queries, kind="stable")
        self.own_terms, self.own_weights = np.repeat(np.arange(self.n_terms), often)[order], weights[order]
        self.own_starts = np.concatenate([[0], np.cumsum(np.bincount(queries, minlength=len(qids)))]).astype(np.int64)
        # Sums of as many products as a query has terms, all above 0, are off by less than this share.
        self.margin = (int(np.diff(self.own_starts).max(initial=0)) + 16) * 2.0**-23
        self.step = max(1, BATCH_SCORES // max(n, len(common), self.n_terms))
        self.wide, self.dense = np.zeros((self.step, max(1, self.n_terms))), np.zeros((self.step, len(common)), self.kind)
        self.scores, self.near = np.empty((self.step, len(qids)), self.kind), np.empty((self.step, len(qids)), bool)

    def add(self, docids: list, lengths, numbers, counts, ends, places=None) -> None:
        """places: the documents' places by docid, where they do not come in that order."""
        i = 0
        while i < len(lengths):
            n = min(self.step, max(self.depth, self.seen))  # few at first: until bars are set, every document is near
            part = slice(i, i + n)
            self._add(docids[part], lengths[part], numbers, counts, ends[i : i + n + 1], None if places is None else places[part])
            i += n
            if self.seen <= 16 * self.depth:
                self.best.settle()

    def _add(self, docids: list, lengths, numbers, counts, ends, places) -> None:
        import numpy as np

        n, n_queries = len(lengths), len(self.qids)
        if places is None:
            places = np.arange(self.seen, self.seen + n)
        self.seen += n
        self.docids += docids
        document = np.repeat(np.arange(n), np.diff(ends))
        term, count = numbers[ends[0] : ends[-1]], counts[ends[0] : ends[-1]]
        scale = K1 * (1 - B + B * lengths / self.mean_length) if self.mean_length else np.full(n, K1)
        impact = count * (K1 + 1) / (count + scale[document])
        self.wide[document, term] = impact
        column = self.column[term]
        common = column >= 0
        cells = document[common], column[common]
        self.dense[cells] = impact[common]
        scores = np.matmul(self.dense[:n], self.matrix, out=self.scores[:n])
        self.dense[cells] = 0
        self._add_rare(scores.reshape(-1), document[~common], term[~common], impact[~common])
        near_document, near = np.divmod(_places_of(np.greater_equal(scores, self._bar(), out=self.near[:n])), n_queries) if n_queries else (np.zeros(0, np.int64),) * 2
        values = np.round(self._exact(near_document, near) + NUDGE, PLACES)
        kept = values >= self.best.bar[near]
        self.best.offer(near[kept], places[near_document[kept]], values[kept])
        self.wide[document, term] = 0

    def _bar(self):
        """What a sum must reach for its query, errors allowed for."""
        import numpy as np

        slack = self.best.bar - 10.0**-PLACES
        return slack if self.whole else np.nextafter(np.maximum(slack - self.margin * self.best.bar, 1e-30).astype(np.float32), np.float32(0))

    def _add_rare(self, scores, document, term, impact) -> None:
        import numpy as np

        begin, often = self.starts[term], self.starts[term + 1] - self.starts[term]
        for part in _slices(often):
            entry = _entries(begin[part], often[part])
            np.add.at(scores, np.repeat(document[part] * len(self.qids), often[part]) + self.queries[entry], (np.repeat(impact[part], often[part]) * self.weights[entry]).astype(self.kind))

    def _exact(self, document, query):
        """Scores of pairs of document of the present batch and query."""
        import numpy as np

        scores, cells = np.zeros(len(query)), self.wide.reshape(-1)
        begin, often = self.own_starts[query], self.own_starts[query + 1] - self.own_starts[query]
        for part in _slices(often):
            entry = _entries(begin[part], often[part])
            products = cells[np.repeat(document[part] * self.wide.shape[1], often[part]) + self.own_terms[entry]] * self.own_weights[entry]
            scores[part] = np.bincount(np.repeat(np.arange(len(often[part])), often[part]), products, len(often[part]))
        return scores

    def rows(self, lang: str, docids, order, pad: bool, pa):
        """Rankings; docids in the order of the documents added, and order: by place, which of them it is. With `pad`, documents of score 0 fill what lacks."""
        import numpy as np

        queries, places, scores = self.best.settle()
        n = min(self.depth, len(docids))
        if pad:
            counts = np.bincount(queries, minlength=len(self.qids))
            until = np.cumsum(counts)
            more = [(q, np.setdiff1d(np.arange(n), places[until[q] - counts[q] : until[q]])[: n - counts[q]]) for q in np.flatnonzero(counts < n)]
            queries = np.concatenate([queries, *(np.full(len(p), q) for q, p in more)])
            places = np.concatenate([places, *(p for _, p in more)])
            scores = np.concatenate([scores, np.zeros(len(queries) - len(scores))])
            by = np.argsort(queries, kind="stable")  # those of score 0 follow
            queries, places, scores = queries[by], places[by], scores[by]
        ranks = np.arange(len(queries)) - np.searchsorted(queries, queries, "left") + 1
        kept = slice(None) if pad else scores != 0
        queries, places, scores, ranks = queries[kept], places[kept], scores[kept], ranks[kept]
        qids = pa.array(self.qids, pa.string())
        for i in range(0, len(queries), 1 << 16):
            q, p, s, r = (x[i : i + (1 << 16)] for x in (queries, places, scores, ranks))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(q), pa.string()), qids.take(pa.array(q)), docids.take(pa.array(order[p])), pa.array(s), pa.array(r, pa.int32())], names=["lang", "qid", "docid", "score", "rank"])


def _entries(begin, often):
    """The numbers from each `begin` on, as many as `often` says, in a row."""
    import numpy as np

    return np.repeat(begin - np.cumsum(often) + often, often) + np.arange(often.sum())


def _slices(often):
    """Slices whose sums are about BATCH_PRODUCTS at most."""
    import numpy as np

    until, at = np.cumsum(often), 0
    while at < len(often):
        stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + BATCH_PRODUCTS, "right")))
        yield slice(at, stop)
        at = stop


def _places_of(mask):
    """Where a mask is set, counted through; looked for by eight at a time."""
    import numpy as np

    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    near = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])
