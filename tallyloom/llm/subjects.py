"""Subject areas of documents.

Sentences are embedded by weighted terms and a truncated singular value
decomposition of the corpus, and compared by cosine with one centroid for each
area and script.  The centroids start from labelled passages.  Each refinement
assigns all sentences, counts terms by area over the whole corpus, weights each
term by how much it tells about the area, and moves the centroids.  A document
is about an area that more than a quarter of its sentences are about.

Counts and sums run over all documents in the tasks; only the model (terms by
dimensions and terms by areas, both bounded by parameters) is on the driver.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import segments
from tallyloom.llm.segments import PARTICLES
from tallyloom.operators.scans import partition_number
from tallyloom.session import cut, write_cut

#: Dimensions of the decomposition.
DIMENSIONS = 64
#: A term stands in this share of the sentences, and in this many, at least: rarer ones tell nothing sure at any size.
MIN_SHARE, MIN_SENTENCES = 2e-5, 5
#: Iterations go on while they gain this share of what the dimensions hold,
POWER_GAIN = 0.002
#: and refinements until no centroid moves by more; they may swing for ever between two states.
SETTLED, MOST_REFINEMENTS = 1e-3, 20
#: Closed Chinese pieces of up to this many clauses teach where sentences begin.
CLOSED_CLAUSES = 3
#: Occurrences that a term's share by area is smoothed with.
SMOOTHING = 5.0
#: A sentence is about an area from this weight of telling terms on, with this cosine at least,
ABOUT, COSINE = 5.0, 0.3
#: while a refinement learns from sentences that are nearer,
LEARN_COSINE = 0.4
#: and is left for its document to decide from this weight on.
HINT = 1.5
#: The share of a document's sentences that must be exceeded.
SHARE = 0.25
BLOCK = 1024
#: Partial sums of this many tasks meet in one.
FAN_IN = 64
#: Documents, and members of a sum, that a task works on at once.
DOCUMENTS_AT_ONCE, STEP = 1_000, 1_024

_FENCE = re.compile(r"^\s*(?:```|~~~)")
_OUTSIDE = re.compile(r"^\s*(?:\||#{1,8}\s|[-=*_]{3,}\s*$|<!--|\$\$)")
_LEAD = re.compile(r"^\s*(?:\[\d{1,2}:\d{2}(?::\d{2})?\]|\d{1,2}:\d{2}(?::\d{2})?\s|(?:[-*+•]|\d{1,3}[.)、])\s|>\s?|(?:User|Assistant|System|Tool|用户|助手|系统|工具)\s*[:：])\s*")
_CUT = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9㐀-鿿])|(?<=[a-z][.!?])(?=[A-Z][a-z]|[㐀-鿿])|(?<=[。！？])[”’」』）]*|(?<=[㐀-鿿])\s+(?=[A-Z][a-z])|(?<=[a-z])\s+(?=[㐀-鿿])")
#: A capital word after a small letter begins a sentence where signs were left out.
_RUN_ON = re.compile(r"(?<=[a-z0-9])\s+(?=[A-Z][a-z]+\b)")
_WORD = re.compile(r"[a-z]+(?:[-'’][a-z]+)*")
_HAN = re.compile(r"[㐀-鿿]+")
_LETTER = re.compile(r"[A-Za-z㐀-鿿]")


def _pieces(text: str):
    """The parts of a text between closing signs, without code, tables, headings and marks before a line."""
    fenced = False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or not line.strip() or _OUTSIDE.match(line):
            continue
        while (lead := _LEAD.match(line)) and lead.end():
            line = line[lead.end() :]
        for part in _CUT.split(line):
            for piece in _RUN_ON.split(part):
                piece = piece.strip()
                if piece and _LETTER.search(piece):
                    yield piece


def _clauses(piece: str) -> list[str]:
    """The clauses of a Chinese piece without their signs; none for other scripts."""
    return [c for c in (x.strip(" 。！？") for x in re.split("[，,]", piece)) if c] if _HAN.search(piece) else []


def sentences(text: str | None, opening: dict[str, float] | None = None) -> list[str]:
    """The sentences of a text, as ``segments`` finds them for many texts at once; tests hold the two together.

    Chinese transcripts often have a comma where a sentence ends.  ``opening``
    gives for the head of a clause and the tail of the one before how much
    (log odds) they speak for a new sentence; without it commas part nothing.
    """
    out: list[str] = []
    for piece in _pieces(text or ""):
        clauses = _clauses(piece) if opening is not None else []
        if len(clauses) < 2:
            out.append(piece)
            continue
        held = clauses[0]
        for before, clause in zip(clauses, clauses[1:]):
            if opening.get("t" + before[-2:], 0.0) + opening.get("h" + clause[:3], 0.0) > 0:
                out.append(held)
                held = clause
            else:
                held += "，" + clause
        out.append(held)
    return out


def terms(sentence: str) -> list[str]:
    """Words of Latin script and pairs of Chinese characters without particles."""
    out = [w for w in _WORD.findall(sentence.lower()) if len(w) > 1]
    for run in _HAN.findall(sentence):
        out += [run[i : i + 2] for i in range(len(run) - 1) if run[i] not in PARTICLES and run[i + 1] not in PARTICLES]
    return out


# --- passes over the corpus --------------------------------------------------

_COUNT = "kind string, key long, n long"


def _counted(groups: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    """How often each key stands in each group."""
    kinds, keys, counts = [], [], []
    for kind, arrays in groups.items():
        k, n = np.unique(np.concatenate(arrays), return_counts=True)
        kinds += [kind] * len(k)
        keys.append(k)
        counts.append(n)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], names=["kind", "key", "n"])


class Batch:
    """The units of a batch as flat arrays."""

    def __init__(self, batch: pa.RecordBatch, terms: bool):
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        self.marks, self.heads, self.tails = flat("marks"), flat("heads"), flat("tails")
        per_doc = batch.column("marks").value_lengths().to_numpy(zero_copy_only=False)
        self.doc = np.repeat(np.arange(batch.num_rows), per_doc)
        if terms:
            self.terms, self.sizes = flat("terms"), flat("sizes")

    def sentences(self, opening: Opening) -> np.ndarray:
        """The number of the sentence that each unit belongs to."""
        new = (self.marks & segments.OPENS) != 0
        new[1:] |= opening.of(self.tails[:-1], self.heads[1:]) > 0
        return np.cumsum(new) - 1


class Opening:
    """How much (log odds) a clause's head and the tail before it speak for a new sentence."""

    def __init__(self, heads: dict[int, float], tails: dict[int, float]):
        self.tables = [(np.array(sorted(t), np.int64), np.array([t[k] for k in sorted(t)])) for t in (tails, heads)]

    def of(self, tails: np.ndarray, heads: np.ndarray) -> np.ndarray:
        return sum((_looked_up(keys, values, at) for (keys, values), at in zip(self.tables, (tails, heads))), np.zeros(len(heads)))


def _looked_up(keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The value of each key, 0 for unknown ones."""
    if not len(keys):
        return np.zeros(len(at))
    k = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[k] == at, values[k], 0.0)


def _openings(batches):
    """How often a clause's head (h) and the tail before it (t) stand at a sentence's start (o) and inside one (c).

    What counts are closed pieces of few clauses: in these a comma surely
    parts no sentences.
    """
    for batch in batches:
        u = Batch(batch, False)
        if not len(u.doc):
            continue
        opens = (u.marks & segments.OPENS) != 0
        piece = np.cumsum(opens) - 1
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(piece)) - 1
        sound = ((u.marks[first] & segments.CLOSED) != 0) & ((u.marks[first] & segments.BARE) == 0) & (u.heads[first] != 0) & (last - first < CLOSED_CLAUSES)
        inner = np.flatnonzero(~opens & sound[piece])
        after = np.flatnonzero(sound[1:] & sound[:-1] & (u.doc[first[1:]] == u.doc[first[:-1]])) + 1
        yield _counted({"ct": [u.tails[inner - 1]], "ch": [u.heads[inner]], "ot": [u.tails[last[after - 1]]], "oh": [u.heads[first[after]]]})


def _term_counts(opening):
    def count(batches):
        for batch in batches:
            u = Batch(batch, True)
            if not len(u.doc):
                continue
            sentence = u.sentences(opening.value)
            known, term = np.unique(u.terms, return_inverse=True)
            pairs = np.unique(np.repeat(sentence, u.sizes) * max(len(known), 1) + term)
            n = np.bincount(pairs % max(len(known), 1), minlength=len(known))
            yield pa.RecordBatch.from_arrays(
                [pa.array(["n"] + ["t"] * len(known)), pa.array(np.append(0, known), pa.int64()), pa.array(np.append(sentence[-1] + 1, n), pa.int64())], names=["kind", "key", "n"]
            )

    return count


def _encode(opening, vocabulary):
    """Each document as the numbers of its terms, sentence by sentence, and its different terms with their counts."""

    def encode(batches):
        keys = vocabulary.value
        for batch in batches:
            u = Batch(batch, True)
            if not len(u.doc):
                continue
            sentence = u.sentences(opening.value)
            n = int(sentence[-1]) + 1
            at = np.minimum(np.searchsorted(keys, u.terms), len(keys) - 1)
            good = keys[at] == u.terms
            term, of_term = at[good].astype(np.int32), np.repeat(sentence, u.sizes)[good]
            size = np.bincount(of_term, minlength=n).astype(np.int32)
            script = np.zeros(n, bool)
            script[sentence[(u.marks & segments.HAN) != 0]] = True
            doc_of_sentence = np.zeros(n, np.int64)
            doc_of_sentence[sentence] = u.doc
            per_doc = np.bincount(doc_of_sentence, minlength=batch.num_rows)
            ends = np.append(0, np.cumsum(per_doc)).astype(np.int32)
            term_ends = np.append(0, np.cumsum(size.astype(np.int64)))[ends].astype(np.int32)
            pair, count = np.unique(doc_of_sentence[of_term] * len(keys) + term, return_counts=True)
            own_ends = np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(keys)).astype(np.int32)
            lists = lambda values, where: pa.ListArray.from_arrays(pa.array(where), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists(term, term_ends), lists(size, ends), lists(script.astype(np.int8), ends), lists((pair % len(keys)).astype(np.int32), own_ends), lists(count.astype(np.int32), own_ends)],
                names=["doc_id", "terms", "sizes", "scripts", "own", "counts"],
            )

    return encode


_ENCODED = "doc_id long, terms array<int>, sizes array<int>, scripts array<byte>, own array<int>, counts array<int>"


class Encoded:
    """A block of encoded documents as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        sizes, self.term, per_sentence = batch.column("sizes"), flat("terms"), flat("sizes")
        self.script, self.own, self.counts = flat("scripts"), flat("own"), flat("counts")
        self.docs, self.ids = batch.num_rows, batch.column("doc_id")
        in_doc = sizes.value_lengths().to_numpy(zero_copy_only=False)
        self.doc_of_sentence = np.repeat(np.arange(self.docs), in_doc)
        self.sentences = len(per_sentence)
        self.sentence = np.repeat(np.arange(self.sentences), per_sentence)
        self.doc = np.repeat(np.arange(self.docs), batch.column("own").value_lengths().to_numpy(zero_copy_only=False))
        self.per_doc = in_doc


def _summed(encoded: DataFrame, rows: int, columns: int, of) -> np.ndarray:
    """The sum over all documents of the matrices (rows x columns) that ``of`` makes of each block.

    Each task adds up its blocks and sends on those slices of rows that are
    not zero.  Slices are added in rounds, FAN_IN tasks' at a time.
    """

    def partial(batches):
        total = np.zeros((rows, columns))
        for e in _blocks(batches):
            total += of(e)
        sent = [(s // BLOCK, total[s : s + BLOCK]) for s in range(0, rows, BLOCK)]
        sent = [(s, part.tobytes()) for s, part in sent if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in sent], pa.int32()), pa.array([partition_number()] * len(sent), pa.int32()), pa.array([d for _, d in sent], pa.binary())], names=["slice", "part", "data"])

    def add(table: pa.Table) -> pa.Table:
        out = 0
        for chunk in table.column("data").chunks:
            for value in chunk:
                out = out + np.frombuffer(value.as_buffer(), np.float64)
        return pa.table({"slice": table.column("slice").slice(0, 1), "part": table.column("part").slice(0, 1), "data": pa.array([out.tobytes()], pa.binary())})

    schema = "slice int, part int, data binary"
    parts, width = encoded.mapInArrow(partial, schema), encoded.rdd.getNumPartitions()
    while width > 1:
        width = -(-width // FAN_IN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(width)).cast("int")).groupBy("slice", "part").applyInArrow(add, schema)
    out = np.zeros((rows, columns))
    for row in parts.collect():  # rows x columns numbers, bounded by the model's size
        block = np.frombuffer(row.data, np.float64).reshape(-1, columns)
        out[row.slice * BLOCK : row.slice * BLOCK + len(block)] += block
    return out


def _blocks(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
            yield Encoded(batch.slice(a, DOCUMENTS_AT_ONCE))


def _embedded(vectors: np.ndarray, row: np.ndarray, index: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``vectors`` (float32) summed by the sorted ``index``.

    The first members of all groups are added, then the second ones, and so
    on; what groups hold beyond STEP members is added group by group.
    """
    count = np.bincount(index, minlength=rows)
    begin = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    begin, sorted_ = begin[order], count[order]
    out = np.zeros((rows, vectors.shape[1]), np.float32)
    for p in range(min(int(sorted_[0]) if rows else 0, STEP)):
        at = begin[: np.searchsorted(-sorted_, -p)] + p
        part = vectors.take(row[at], axis=0)
        if weights is not None:
            part *= weights[at, None]
        out[: len(at)] += part
    for g in range(int(np.searchsorted(-sorted_, -STEP))):
        for a in range(begin[g] + STEP, begin[g] + sorted_[g], STEP):
            at = slice(a, min(a + STEP, begin[g] + sorted_[g]))
            out[g] += vectors[row[at]].sum(0) if weights is None else weights[at] @ vectors[row[at]]
    back = np.empty(rows, np.int64)
    back[order] = np.arange(rows)
    return out[back]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _doc_weights(e: Encoded, idf: np.ndarray) -> np.ndarray:
    """The documents' terms as unit vectors of (1 + log count) times inverse frequency."""
    w = (1 + np.log(e.counts)) * idf[e.own]
    return (w / np.maximum(np.sqrt(np.bincount(e.doc, w * w, e.docs)), 1e-12)[e.doc]).astype(np.float32)


class Model:
    """Terms with their vectors and weights, and the centroids by script and area."""

    def __init__(self, areas, vectors, weight, centroids, telling):
        self.areas, self.vectors, self.weight, self.centroids, self.telling = areas, vectors, weight, centroids, telling
        self.weighted = (weight[:, None] * vectors).astype(np.float32)

    def score(self, e: Encoded, mean: np.ndarray | None = None):
        """Cosine with each area and the weight of telling terms of each sentence."""
        v = _embedded(self.weighted, e.term, e.sentence, e.sentences)
        if mean is not None:
            v = v - mean.astype(np.float32)[e.script]
        v = _unit(v)
        cosine = np.empty((e.sentences, len(self.areas)), np.float32)
        for s in (0, 1):
            at = e.script == s
            cosine[at] = v[at] @ self.centroids[s].T.astype(np.float32)
        return cosine, np.bincount(e.sentence, self.weight[e.term], e.sentences)

    def label(self, e: Encoded, mean: np.ndarray | None = None, least: float = 0.0, margin: float = 0.15) -> np.ndarray:
        """The area of each sentence, or the number of areas for none."""
        cosine, weight = self.score(e, mean)
        first = cosine.argmax(1)
        top = np.sort(cosine, axis=1)
        second = top[:, -2] if top.shape[1] > 1 else 0.0
        sure = (top[:, -1] > LEARN_COSINE) & (top[:, -1] - second > margin) & (weight >= least)
        return np.where(sure, first, len(self.areas))


def _least(total: int) -> int:
    """How often a term, or a clause's head or tail, stands in a corpus of ``total`` sentences at least."""
    return max(MIN_SENTENCES, math.ceil(MIN_SHARE * total))


def fit(corpus: DataFrame, examples: list[tuple[str, str]]) -> tuple[Model | None, DataFrame | None]:
    """The model of a corpus, and the corpus encoded for it.

    ``corpus``: doc_id, text.  ``examples``: (area, passage) pairs.
    """
    spark = corpus.sparkSession
    areas = sorted({a for a, _ in examples})
    opening, counts, total, table = _counts(corpus)
    # Bounded: a term stands in MIN_SHARE of the sentences at least, and a sentence has few terms.
    keys = np.array(sorted(r.key for r in counts.where(f"kind = 't' and n >= {_least(total)}").select("key").collect()), np.int64)
    if not total or not len(keys) or not areas:
        table.drop()
        return None, None
    n_of = dict(counts.where(f"kind = 't' and n >= {_least(total)}").select("key", "n").collect())
    n_terms = len(keys)
    idf = np.log(total / np.array([n_of[k] for k in keys.tolist()]))
    vocabulary = spark.sparkContext.broadcast(keys)
    encoded = cut(table.read().mapInArrow(_encode(opening, vocabulary), _ENCODED), "encoded")
    table.drop()

    # Truncated singular value decomposition by power iterations with a random start, until they gain nothing.
    k = min(DIMENSIONS, n_terms)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((n_terms, k)))[0]
    own = encoded.select("doc_id", "sizes", "scripts", "own", "counts").withColumn("terms", F.array().cast("array<int>"))

    def product(q):
        sent = spark.sparkContext.broadcast(q.astype(np.float32))

        def of(e: Encoded):
            w = _doc_weights(e, idf)
            y = _embedded(sent.value, e.own, e.doc, e.docs, w)
            order = np.argsort(e.own, kind="stable")
            return _embedded(y, e.doc[order], e.own[order], n_terms, w[order])

        out = _summed(own, n_terms, k, of)
        sent.destroy()
        return out

    energy, image = 0.0, product(basis)
    while (now := float(np.trace(basis.T @ image))) > energy * (1 + POWER_GAIN):
        energy = now
        basis, _ = np.linalg.qr(image)
        image = product(basis)
    values, turn = np.linalg.eigh(basis.T @ image)
    vectors = basis @ turn[:, np.argsort(-values)]

    # Seeds: the mean direction of each area's passages, by script, away from the corpus mean.
    mean = _mean_by_script(encoded, vectors, idf)
    seeds: list[list[np.ndarray]] = [[], []]
    known = [(a, _passage(t, opening.value, keys)) for a, t in examples]
    for script in (0, 1):
        for area in areas:
            found = [f for a, parts in known if a == area for s, f in parts if s == script and len(f)]
            embedded = [(idf[f][:, None] * vectors[f]).sum(0) - mean[script] for f in found]
            seeds[script].append(_unit(_unit(np.array(embedded)).mean(0)) if embedded else np.zeros(k))
    model = Model(areas, vectors, idf, np.array(seeds), idf)
    han = (keys < segments.WORDS_FROM).astype(int)
    step = 0
    while True:
        before = model.centroids
        model = _refined(encoded, model, idf, han, mean if step == 0 else None, 0.0 if step == 0 else (1.0 if step == 1 else ABOUT - 1))
        step += 1
        if step > 2 and (np.abs(model.centroids - before).max() < SETTLED or step == MOST_REFINEMENTS):
            return model, encoded


def _counts(corpus: DataFrame):
    """The opening model (sent to the tasks), the term counts, the number of sentences and the written units of a corpus."""
    spark = corpus.sparkSession
    table = write_cut(corpus.mapInArrow(segments.encode, segments.SCHEMA), "units")
    seen = table.read().select("doc_id", "marks", "heads", "tails").mapInArrow(_openings, _COUNT).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    seen = cut(seen, "openings")
    least = F.col("o") + F.col("c") >= _least(seen.where("kind in ('oh', 'ch')").agg(F.sum("n")).first()[0] or 0)
    both = seen.groupBy(F.substring("kind", 2, 1).alias("side"), "key").agg(*[F.sum(F.when(F.col("kind").startswith(x), F.col("n")).otherwise(0)).alias(x) for x in "oc"])
    rows = both.where(least).collect()  # bounded as the vocabulary is
    starts, inner = (sum(getattr(r, x) for r in rows) + 2 for x in "oc")
    odds = {side: {r.key: float(np.log((r.o + 1) / starts) - np.log((r.c + 1) / inner)) for r in rows if r.side == side} for side in "ht"}
    opening = spark.sparkContext.broadcast(Opening(odds["h"], odds["t"]))
    counts = cut(table.read().mapInArrow(_term_counts(opening), _COUNT).groupBy("kind", "key").agg(F.sum("n").alias("n")), "terms")
    total = counts.where("kind = 'n'").agg(F.sum("n")).first()[0] or 0
    return opening, counts, total, table


def _passage(text: str, opening: Opening, keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Script and known terms of each sentence of a text."""
    batch = next(iter(segments.encode([pa.record_batch({"doc_id": pa.array([0]), "text": pa.array([text])})])))
    if not batch.num_rows:
        return []
    u = Batch(batch, True)
    sentence = u.sentences(opening)
    out = []
    for s in range(int(sentence[-1]) + 1):
        terms_ = u.terms[np.repeat(sentence == s, u.sizes)]
        at = np.minimum(np.searchsorted(keys, terms_), len(keys) - 1)
        out.append((int(((u.marks[sentence == s] & segments.HAN) != 0).any()), at[keys[at] == terms_]))
    return out


def _mean_by_script(encoded: DataFrame, vectors: np.ndarray, idf: np.ndarray) -> np.ndarray:
    k = vectors.shape[1]
    weighted = (idf[:, None] * vectors).astype(np.float32)

    def of(e: Encoded):
        v = _embedded(weighted, e.term, e.sentence, e.sentences)
        return np.array([np.append(v[e.script == s].sum(0, dtype=np.float64), (e.script == s).sum()) for s in (0, 1)])

    total = _summed(encoded, 2, k + 1, of)
    return total[:, :k] / np.maximum(total[:, k:], 1)


def _refined(encoded: DataFrame, model: Model, idf: np.ndarray, han: np.ndarray, mean, least: float) -> Model:
    """One refinement over all sentences: term counts by area, then weights and centroids."""
    n_terms, n_areas = len(idf), len(model.areas)
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def of(e: Encoded):
        label = sent.value.label(e, mean, least)
        by_term = np.bincount(e.term.astype(np.int64) * (n_areas + 1) + label[e.sentence], minlength=n_terms * (n_areas + 1)).reshape(n_terms, n_areas + 1)
        return np.vstack([by_term, [np.bincount(label[e.script == s], minlength=n_areas + 1) for s in (0, 1)]]).astype(float)

    total = _summed(encoded, n_terms + 2, n_areas + 1, of)
    sent.destroy()
    counts, sizes = total[:n_terms], total[n_terms:, :n_areas]
    rate = counts[:, :n_areas] / np.maximum(sizes / np.maximum(sizes.sum(1, keepdims=True), 1), 1e-6)[han]
    hits = counts[:, :n_areas].sum(1, keepdims=True)
    share = rate / np.maximum(rate.sum(1, keepdims=True), 1e-12) * hits
    share = (share + SMOOTHING / n_areas) / (hits + SMOOTHING)
    entropy = -(share * np.log(share)).sum(1) / np.log(max(n_areas, 2))
    covered = hits[:, 0] / (counts.sum(1) + SMOOTHING)
    weight = idf * np.maximum(0, 1 - entropy) ** 1.5 * covered
    centroids = np.array([_unit(((counts[:, :n_areas] * (han == s)[:, None] * weight[:, None]).T) @ model.vectors) for s in (0, 1)])
    return Model(model.areas, model.vectors, weight, centroids, share)


def vocabulary(corpus: DataFrame) -> DataFrame:
    """What the model leaves out: sentences, terms, kept_terms, uses, share_outside (of the terms' uses in sentences)."""
    opening, counts, total, table = _counts(corpus.where("doc_id is not null and text is not null").select("doc_id", "text"))
    table.drop()
    kept = F.col("n") >= _least(total)
    out = counts.where("kind = 't'").agg(F.count("*").alias("terms"), F.count(F.when(kept, 1)).alias("kept_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("uses"), F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("outside"))
    share = F.when(F.col("uses") > 0, F.col("outside") / F.col("uses")).otherwise(0.0)
    return out.select(F.lit(total).cast("long").alias("sentences"), "terms", "kept_terms", "uses", share.alias("share_outside"))


def subject_areas(corpus: DataFrame, examples: DataFrame) -> DataFrame:
    """The areas of each document: doc_id, area.

    ``corpus``: doc_id (unique), text.  ``examples``: area, sample_text, a
    small table of labelled passages.  A document has an area if more than
    SHARE of its sentences are about it; it may have none.  Null, empty and
    blank texts and texts without sentences have none; an empty corpus or no
    examples give no rows.
    """
    spark = corpus.sparkSession
    texts = corpus.where("doc_id is not null and text is not null").select("doc_id", "text")
    pairs = [(r.area, r.sample_text) for r in examples.where("area is not null and sample_text is not null").select("area", "sample_text").collect()]
    model, encoded = fit(texts, pairs)
    if model is None:
        return spark.createDataFrame([], "doc_id long, area string")
    sent = spark.sparkContext.broadcast(model)
    names = model.areas

    def judge(batches):
        m = sent.value
        for e in _blocks(batches):
            doc, area = np.nonzero(about(m, e) > SHARE * e.per_doc[:, None])
            yield pa.RecordBatch.from_arrays([e.ids.take(pa.array(doc)), pa.array([names[a] for a in area], pa.string())], names=["doc_id", "area"])

    return encoded.mapInArrow(judge, "doc_id long, area string")


def about(model: Model, e: Encoded) -> np.ndarray:
    """How many sentences of each document are about each area.

    A sentence whose telling terms belong to several areas counts for the one
    of them that most of its document's other sentences are about.
    """
    cosine, weight = model.score(e)
    n = len(model.areas)
    best, top = cosine.argmax(1), cosine.max(1)
    sure = (weight >= ABOUT) & (top >= COSINE)
    counts = np.bincount(e.doc_of_sentence[sure] * n + best[sure], minlength=e.docs * n).reshape(e.docs, n)
    open_ = np.flatnonzero(~sure & (weight >= HINT))
    if len(open_):
        near = (cosine[open_] >= COSINE / 2) * counts[e.doc_of_sentence[open_]]
        choice, support = near.argmax(1), near.max(1)
        ok = support * 4 > e.per_doc[e.doc_of_sentence[open_]]
        counts = counts + np.bincount(e.doc_of_sentence[open_[ok]] * n + choice[ok], minlength=e.docs * n).reshape(e.docs, n)
    return counts
