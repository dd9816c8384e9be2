"""Subjects of documents by the sentences that treat them.

The vocabulary is that of a bounded sample of labelled documents. Every text is read once, into the numbers
of its sentences' terms. Terms are weighted by how few documents of the language have them, counted over all
documents. For each language, the sample is embedded by truncated singular value decomposition; a subject's
seed is the centroid of the documents that raters gave it, and "none" is seeded by those in which they found
no subject. Sentences are embedded with the same terms and assigned to the centroid of the highest cosine;
centroids are replaced by those of their sentences and the assignment is repeated. A document has the
subjects that more than a quarter of its sentences treat.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import counted_side, materialise, shared_folder
from ..plans.spread import spread
from .budget import plain_language, plain_name
from .lookalike import normal_form

#: Labelled documents a language on which the embedding is fitted. Their terms are the vocabulary, all of them.
FIT_DOCUMENTS = 1500
#: Languages that can have a model, subjects, and terms of the vocabulary; more are an error.
MOST_LANGUAGES, MOST_TERMS = 200, 2_000_000
#: Documents of the language, labelled or not, that must have a term for it to be weighted; dimensions of the embedding; rounds of refinement.
LEAST_DOCUMENTS, DIMENSIONS, ROUNDS = 3, 32, 6
#: Share of its sentences beyond which a document has a subject.
SHARE = 0.25
#: Share of a sentence's terms that its document's language must know, else the language that knows most is asked; below the second no language is.
KNOWN, LEAST_KNOWN = 0.4, 0.2
NONE = ""


#: Letters with their marks, joined by hyphens, apostrophes and joiners.
WORD = r"[\p{L}\p{M}]+(?:[-'’\u200c\u200d][\p{L}\p{M}]+)*"


@lru_cache(maxsize=1)
def patterns():
    import regex

    return {
        "lines": regex.compile(r"[\r\n\u2028\u2029]+"),
        "tags": regex.compile(r"</?[a-zA-Z][^<>]*>|\w+://\S+|&\w+;"),
        "heading": regex.compile(r"^\s*(=+[^=]*=+|#+\s.*)\s*$"),
        "opening": regex.compile(r"^\s*((\p{N}+[.)]|[-*•])\s+)?(@\w+:\s*)?"),
        "brackets": regex.compile(r"\s*\([^()]*\)"),
        "notes": regex.compile(r"\[\p{N}+\]"),
        "links": regex.compile(r"\[\[|\]\]"),
        "ends": regex.compile(r"[.!?؟۔।॥]+(?:[\"'”’»]*(?=\s+[^\p{Ll}\s]|\x01|\s*$)|(?=[\"“]?[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]))|[。｡]+"),
        # scripts without full stops and blanks between words: a blank between two letters ends a sentence, a note does so always
        "thai ends": regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\"])\x01? +(?=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\"])|\x01"),
        "thai": regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"),
        "letters": regex.compile(r"\p{L}[^\p{L}]*\p{L}"),
        "numeral": regex.compile(r"[ivxlcdm]+"),
        "terms": regex.compile(r"(?P<han>\p{Han}+)|(?P<kana>[\p{Katakana}ー]+|\p{Hiragana}+)|(?P<thai>[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+)|(?P<word>" + WORD + ")"),
        "words": regex.compile(WORD),
        "unspaced": regex.compile(r"[\p{Han}\p{Katakana}\p{Hiragana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"),
    }


def sentences(text: str | None, lang: str | None) -> list[str]:
    """The sentences of a text, without markup, numbering, names of members, notes and brackets; headings and page numbers are none.

    A full stop before a small letter belongs to an abbreviation.
    """
    use, found = patterns(), []
    thai = text and use["thai"].search(text)
    for line in use["lines"].split(text or ""):
        if "<" in line or "&" in line or "://" in line:
            line = use["tags"].sub(" ", line)
        if use["heading"].match(line):
            continue
        line = use["opening"].sub("", normal_form(line, lang) or "")
        if "(" in line:
            line = use["brackets"].sub("", line)
        if "[" in line:
            line = use["notes"].sub("\x01", use["links"].sub("", line))
        parts = use["ends"].split(line)
        if thai and use["thai"].search(line):
            parts = [x for p in parts for x in use["thai ends"].split(p)]
        found += [s for p in parts if use["letters"].search(p) and not use["numeral"].fullmatch(s := p.strip(" \x01"))]
    return found


@lru_cache(maxsize=1 << 16)
def beginnings(word: str) -> tuple[str, ...]:
    """A word without its last two letters, without its last, and whole; of short words fewer."""
    return tuple(word[:n] for n in range(min(len(word), max(4, len(word) - 2)), len(word) + 1))


def terms(sentence: str, spaced: bool = False) -> list[str]:
    """Terms in lower case: words and their beginnings, so that endings matter less; of scripts without blanks, short runs of characters.

    `spaced` says that the sentence has no script without blanks.
    """
    use, found, sentence = patterns(), [], sentence.lower()
    if spaced or not use["unspaced"].search(sentence):
        for word in use["words"].findall(sentence):
            found += beginnings(word)
        return found
    for m in use["terms"].finditer(sentence):
        word, kind = m.group(), m.lastgroup
        if kind == "han":
            found += [word] if len(word) < 3 else [word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)]
        elif kind == "thai":
            found += [word[i : i + n] for n in (3, 5) for i in range(len(word) - n + 1)] or [word]
        elif kind == "kana":
            found.append(word)
        else:
            found += beginnings(word)
    return found


class Model:
    """A language's terms, by their numbers in order, and what each adds to a sentence's likeness to each subject, NONE being the last."""

    def __init__(self, known, scores, shift):
        self.known, self.scores, self.shift = known, scores, shift

    def places(self, numbers):
        """The place of each term, and which of them the language knows."""
        import numpy as np

        places = np.minimum(np.searchsorted(self.known, numbers), len(self.known) - 1)
        return places, self.known[places] == numbers

    def subjects(self, places, there, starts, ends):
        """The number of the subject of each sentence, the last if it treats none."""
        import numpy as np

        none = len(self.shift) - 1
        sums = between(self.scores[places] * there[:, None], starts, ends) - between(there, starts, ends)[:, None] * self.shift
        return np.where(sums.max(1) > 0, sums.argmax(1), none)


def between(values, starts, ends):
    """The sums of `values` from each start to its end."""
    import numpy as np

    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=float)])
    return sums[ends] - sums[starts]


def fit(documents: list[list], labels: list[set[str]], found_in: dict[int, int], n_documents: int, subjects: list[str]) -> Model | None:
    """A language's model of labelled documents, each a list of its sentences' terms by number; `found_in` counts over all documents."""
    from collections import Counter

    import numpy as np

    known = np.array(sorted({int(t) for document in documents for s in document for t in s if found_in.get(int(t), 0) >= LEAST_DOCUMENTS}), np.int32)
    if not len(known):
        return None
    number = {t: i for i, t in enumerate(known.tolist())}
    weight = np.array([np.log(n_documents / n) if 0 < (n := found_in.get(t, 0)) < n_documents else 0.0 for t in known.tolist()])
    matrix = []
    for document in documents:
        counts = Counter(number[t] for s in document for t in s if t in number)
        places = np.fromiter(counts, np.int64, len(counts))
        values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts))) * weight[places]
        matrix.append((places, (values / max(np.linalg.norm(values), 1e-9)).astype(np.float32)))
    basis = leading_directions(matrix, len(known), DIMENSIONS)
    if not basis.shape[1]:
        return None
    embedded = times(matrix, basis)
    classes = [*subjects, NONE]
    chosen = [[i for i, own in enumerate(labels) if c in own and len(own) == 1] for c in classes]
    if not any(chosen):
        return None
    mean = embedded[sorted(i for rows in chosen for i in rows)].mean(0)
    term_vectors = basis * weight[:, None]
    rows = [[number[t] for t in s if t in number] for document in documents for s in document]
    parts = np.array([term_vectors[r].sum(0) if r else np.zeros(basis.shape[1]) for r in rows])
    lengths = np.array([max(len(r), 1) for r in rows])
    shift = parts.sum(0) / lengths.sum()
    parts = unit(parts - shift * lengths[:, None])
    centroids = unit(np.array([embedded[i].mean(0) - mean if i else np.zeros(basis.shape[1]) for i in chosen]))
    for _ in range(ROUNDS):
        near = parts @ centroids.T
        best = near.argmax(1)
        sure = near.max(1) > 0.5
        centroids = unit(np.array([parts[(best == k) & sure].mean(0) if ((best == k) & sure).any() else centroids[k] for k in range(len(classes))]))
    # a sentence's cosines with all centroids have one norm in common, so their order and signs are those of the sums
    return Model(known, (term_vectors @ centroids.T).astype(np.float32), (centroids @ shift).astype(np.float32))


def times(matrix, columns):
    """The product of a sparse matrix, given as each row's places and values, with dense columns."""
    import numpy as np

    return np.array([values @ columns[places] for places, values in matrix])


def transposed_times(matrix, width: int, columns):
    import numpy as np

    found = np.zeros((width, columns.shape[1]), columns.dtype)
    for (places, values), row in zip(matrix, columns):
        found[places] += values[:, None] * row
    return found


def leading_directions(matrix, width: int, n: int):
    """The first `n` right singular vectors of a sparse matrix as columns, by subspace iteration; fewer if the rank is less."""
    import numpy as np

    extra = min(n + 16, len(matrix), width)
    found = np.random.default_rng(0).standard_normal((width, extra)).astype(np.float32)
    for _ in range(8):
        found = np.linalg.qr(transposed_times(matrix, width, np.linalg.qr(times(matrix, found))[0]))[0]
    _, values, right = np.linalg.svd(times(matrix, found), full_matrices=False)
    return (found @ right.T)[:, : min(n, int((values > 1e-3).sum()))].astype(float)


def unit(rows):
    import numpy as np

    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def treated(langs: list, numbers, offsets, ends, n_sentences, sizes, models: Models, n_subjects: int):
    """How many sentences of each text treat each subject, a row a text; each sentence is read by the language that knows its terms.

    numbers: the terms of all sentences, those of a text from one of `offsets` to the next; ends: where each sentence
    ends in its text, those of a text from one of `n_sentences` to the next; sizes: how many terms each has, known ones or not.
    """
    import numpy as np

    text = np.repeat(np.arange(len(langs)), np.diff(n_sentences))
    ends = ends + offsets[text]
    starts = np.concatenate([[0], ends[:-1]])
    found = np.full(len(ends), n_subjects)
    strange = np.zeros(len(ends), bool)
    codes = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
    tongues = np.array([codes[lang] for lang in langs])[text] if len(text) else text
    for lang, code in codes.items():
        own, model = np.flatnonzero(tongues == code), models.get(lang)
        if model is None:
            strange[own] = True
            continue
        lengths = ends[own] - starts[own]
        until = np.cumsum(lengths)
        places, there = model.places(numbers[np.repeat(starts[own] - until + lengths, lengths) + np.arange(lengths.sum())])
        familiar = between(there, until - lengths, until) >= KNOWN * sizes[own]
        strange[own[~familiar]] = True
        found[own[familiar]] = model.subjects(places, there, (until - lengths)[familiar], until[familiar])
    at, tongue = None, None
    for i in np.flatnonzero(strange).tolist():
        if text[i] != at:
            at, own = text[i], models.get(langs[text[i]])
            tongue = own
        part = numbers[starts[i] : ends[i]]
        reader = best_reader(part, int(sizes[i]), tongue, models)
        if reader is not None:
            tongue = own or reader
            found[i] = reader.subjects(*reader.places(part), np.array([0]), np.array([len(part)]))[0]
    return np.bincount(text * (n_subjects + 1) + found, minlength=len(langs) * (n_subjects + 1)).reshape(-1, n_subjects + 1)[:, :n_subjects]


def best_reader(numbers, size: int, tongue: Model | None, models: Models) -> Model | None:
    """The model that reads a sentence: `tongue` if it knows enough of the terms, else the one that knows most; none if that is too few."""
    most = int(tongue.places(numbers)[1].sum()) if tongue else 0
    if tongue and most >= KNOWN * size:
        return tongue
    best = tongue
    for model in models.all():
        if (n := int(model.places(numbers)[1].sum())) > most:
            best, most = model, n
    return best if most >= max(1, LEAST_KNOWN * size) else None


class Models:
    """The models of all languages, each read from its file in the shared folder when it is first asked for."""

    def __init__(self, files: dict[str, str]):
        self.files, self.read = files, {}

    def get(self, lang: str | None) -> Model | None:
        if lang not in self.files:
            return None
        if lang not in self.read:
            from pyarrow import fs

            files, path = fs.FileSystem.from_uri(self.files[lang])
            with files.open_input_stream(path) as source:
                self.read[lang] = pickle.loads(source.read())
        return self.read[lang]

    def all(self) -> list[Model]:
        return [self.get(lang) for lang in self.files]


@lru_cache(maxsize=2)
def models_of(files: tuple[tuple[str, str], ...]) -> Models:
    """One set of models a worker, whatever tasks it runs."""
    return Models(dict(files))


def fit_sample(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lot, subjects) of about FIT_DOCUMENTS labelled documents a language, those whose hashes come first; not fewer if there are so many.

    labels: (doc_id, subject), null for a rater who found none; several raters' subjects are put together. Labelled documents
    are counted by language, and a share of the hashes is kept that holds FIT_DOCUMENTS of them with eight standard
    deviations to spare; `fit_models` makes the exact cut. So no language is sorted.
    """
    given = labels.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set(F.coalesce(plain_name(F.col("subject")), F.lit(NONE))).alias("subjects"))
    keyed = df.where("lang is not null and text is not null").groupBy("doc_id").agg(F.min("lang").alias("lang")).join(given, "doc_id")
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    keyed = materialise(keyed.select("doc_id", "lang", lot.alias("lot"), "subjects"))
    shares, _ = counted_side(keyed.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(FIT_DOCUMENTS + 8 * FIT_DOCUMENTS**0.5) / F.count(F.lit(1))).alias("share")))
    return keyed.join(shares, "lang").where(F.col("lot") <= F.col("share") * F.lit(float(1 << 40))).select("doc_id", "lot", "subjects")


def vocabulary(texts: DataFrame) -> list[str]:
    """The distinct terms of a bounded sample (lang, text), sorted."""

    def batches(source: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in source:
            found = {t for lang, text in zip(*(c.to_pylist() for c in batch.columns)) for s in sentences(text, lang) for t in terms(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["term"])

    own = materialise(texts.select("lang", "text").mapInArrow(batches, "term string").distinct())
    if own.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms in the sample")
    return sorted(r.term for r in own.toLocalIterator())


def encode(df: DataFrame, known: list[str]) -> DataFrame:
    """(doc_id, lang, numbers, ends, sizes) of every text that has a sentence: its sentences' distinct terms that are `known`, by number; where each sentence ends; how many terms it has."""
    shared = df.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(known)})

    def batches(source: Iterator) -> Iterator:
        from itertools import repeat

        import numpy as np
        import pyarrow as pa

        number, unspaced = shared.value.get, patterns()["unspaced"].search
        lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.asarray(values, np.int32)))
        for batch in source:
            kept, numbers, sizes, n_sentences = [], [], [], [0]
            for i, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                spaced = not unspaced(text)
                for s in sentences(text, lang):
                    own = set(terms(s, spaced))
                    numbers += map(number, own, repeat(-1))
                    sizes.append(len(own))
                if len(sizes) > n_sentences[-1]:
                    kept.append(i)
                    n_sentences.append(len(sizes))
            numbers, sizes, n_sentences, rows = np.array(numbers, np.int32), np.array(sizes, np.int64), np.array(n_sentences), pa.array(kept, pa.int64())
            there = np.concatenate([[0], np.cumsum(numbers >= 0)])
            ends = there[np.concatenate([[0], np.cumsum(sizes)])]
            offsets = ends[n_sentences]
            own_ends = ends[1:] - np.repeat(offsets[:-1], np.diff(n_sentences))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), lists(numbers[numbers >= 0], offsets), lists(own_ends, n_sentences), lists(sizes, n_sentences)], names=["doc_id", "lang", "numbers", "ends", "sizes"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return spread(df.where("text is not null").select("doc_id", "lang", "text"), "doc_id").mapInArrow(batches, f"doc_id {kind}, lang string, numbers array<int>, ends array<int>, sizes array<int>")


def document_counts(encoded: DataFrame) -> DataFrame:
    """(lang, number, n): in how many documents of each language a term of the vocabulary occurs, over all of them; the number -1 has the language's documents.

    Counts are merged by map task before they are shuffled.
    """
    each = encoded.where("lang is not null").select("lang", F.explode(F.array_union(F.col("numbers"), F.array(F.lit(-1)))).alias("number"))
    return each.groupBy("lang", "number").agg(F.count(F.lit(1)).alias("n"))


def fit_models(encoded: DataFrame, sample: DataFrame, subjects: list[str], folder: str) -> dict[str, str]:
    """The file of each language's model, for languages that have labelled documents; each is fitted by one task over its bounded sample and written to the shared folder."""

    def language(key, counted, sample):
        import numpy as np
        import pandas as pd
        from pyarrow import fs

        found_in = dict(zip(counted["number"].tolist(), counted["n"].tolist()))
        sample = sample.sort_values(["lot", "doc_id"]).head(FIT_DOCUMENTS)
        documents = [np.split(np.asarray(numbers), np.asarray(ends)[:-1]) for numbers, ends in zip(sample["numbers"], sample["ends"])]
        model = fit([[s.tolist() for s in d] for d in documents], [set(x) for x in sample["subjects"]], found_in, found_in.get(-1, 0), subjects) if len(sample) else None
        if model is None:
            return pd.DataFrame([], columns=["lang", "file"], dtype=object)
        uri = f"{folder}/model-{uuid.uuid4().hex}"
        files, path = fs.FileSystem.from_uri(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path) as out:
            out.write(pickle.dumps(model))
        return pd.DataFrame([(key[0], uri)], columns=["lang", "file"], dtype=object)

    own = encoded.where("lang is not null").join(sample, "doc_id").dropDuplicates(["doc_id"]).select(F.col("lang").alias("lang"), "doc_id", "lot", "subjects", "numbers", "ends")
    written = materialise(document_counts(encoded).groupBy("lang").cogroup(own.groupBy("lang")).applyInPandas(language, "lang string, file string"))
    return {r.lang: r.file for r in few(written, "languages with a model")}


def few(df: DataFrame, what: str) -> list:
    """The rows of `df`, collected; an error if there are more than MOST_LANGUAGES."""
    rows = df.orderBy(df.columns[0]).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} {what}")
    return rows


def subject_shares(df: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subject, n_treating, n_sentences) for every row of `df` and each subject that a sentence treats.

    df: (doc_id, lang, text), with languages as `plain_language` gives them; a null or wrong language is made up for by the
    languages that know the terms. Null, empty and blank texts have no sentence and no row. Repeated rows
    give repeated rows. Without labels there is no model and no row.
    """
    spelt = {s.strip().lower(): s for s in subjects}
    sample, _ = counted_side(fit_sample(df, labels), FIT_DOCUMENTS * 40)
    known = vocabulary(df.where("lang is not null and text is not null").join(sample.select("doc_id"), "doc_id"))
    encoded = materialise(encode(df, known))
    files = tuple(fit_models(encoded, sample, sorted(spelt), f"{shared_folder(df.sparkSession)}/subjects-{uuid.uuid4().hex}").items())

    def batches(source: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        models, names = models_of(files), pa.array([spelt[x] for x in sorted(spelt)], pa.string())
        for batch in source:
            (numbers, offsets), (ends, n_sentences), (sizes, _) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy().astype(int)) for c in batch.columns[2:])
            counts = treated(batch.column(1).to_pylist(), numbers, offsets, ends, n_sentences, sizes, models, len(names))
            texts, subject = counts.nonzero()
            n = np.diff(n_sentences)[texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts)), names.take(pa.array(subject)), pa.array(counts[texts, subject], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "subject", "n_treating", "n_sentences"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(batches, f"doc_id {kind}, subject string, n_treating bigint, n_sentences bigint")


def document_subjects(df: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subject): the subjects that more than a quarter of a document's sentences treat."""
    return subject_shares(df, labels, subjects).where(F.col("n_treating") > F.col("n_sentences") * SHARE).select("doc_id", "subject")


def plain_documents(df: DataFrame) -> DataFrame:
    """(doc_id, lang, text) as `subject_shares` takes them."""
    return df.select("doc_id", plain_language(F.col("lang")).alias("lang"), "text")
