"""Language-model scores by a weighted backoff automaton.

The model is a backoff model of n-grams up to three words, with all that training has: nothing is cut off. It is
smoothed by Dirichlet priors: after a history ``h`` that training has ``c(h)`` times, a word has
``(c(h w) + k * p(w | h')) / (c(h) + k)``, where ``h'`` is ``h`` without its first word; the lowest level is the smoothed
unigram distribution over all training tokens. As an automaton: the states are the seen histories; a seen
continuation is an arc with that probability; whatever else takes the failure arc, of weight ``k / (c(h) + k)``, to the
state of ``h'``, and so on down to the root, which has an arc for every word. Probabilities after any history
sum to one over the V seen words and one unseen. A text is scored in one traversal from left to right, which
carries the state and sums the logarithms of what it passes.

The automaton is never in one place. Texts are numbered into chunks of about ``chunk_tokens`` tokens (documents stay
whole), twice: to count and to score; a chunk that isn't the same both times is an error, so a source that changes
order when it is read again is to be settled first. A chunk sends its distinct n-grams, with their training counts, to parts of
the range of their hashes; a part adds up what all chunks say, about ``part_tokens`` tokens' worth of it at once, and
returns to each chunk the totals of just its n-grams: the arcs and states its texts can touch. So the model grows with
the corpus, memory doesn't, and an n-gram that a third of all texts have is one entry for each chunk. What is sent is
sorted and packed, some four bytes for an n-gram.

Defined results: a null or blank text is the end token alone; unseen words are scored by the smoothing; a null
doc_id counts as an empty one (and is in training); repeated rows count as often as they are there and get equal
scores; with no training tokens every text gets the uniform smoothing of the unseen; no rows give no rows. Words are told
apart by 56 bits of hash, longer n-grams by as many as leave about one in 60,000 that shares its hash with
another (62 at most). Further columns stay; those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle
from .langid import fold

ADD = 0.1
#: The weight of the shorter history, in occurrences, after one word and after two; chosen on the held-out fold.
PRIORS = (500.0, 4.0)
#: Words hold no space, so these are the hashes of no word.
END, START = (np.uint64(xxhash.xxh64_intdigest(x) >> 8) for x in (b" ", b"  "))
#: Bits of the hash of a word.
WORD = 56
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """The hash of each word; the cache is emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word) >> 8
        if len(self) >= 200_000:
            self.clear()
        self[word] = h
        return h


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte of all, compressed; small ones take little."""
    x = np.ascontiguousarray(x, np.uint64)
    used = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[:used])
    return len(x).to_bytes(8, "little") + bytes([used]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n, used = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((8, n), np.uint8)
    if n and used:
        out[:used] = np.frombuffer(pa.decompress(data[9:], n * used, codec="zstd", asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(out.T).view(np.uint64).reshape(-1)


def _mixed(x: np.ndarray, order: int, width: int) -> np.ndarray:
    """Well spread keys of ``width`` bits, with the order in the last two."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x >> np.uint64(66 - width) << np.uint64(2) | np.uint64(order)


def ngrams(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the n-grams of 2 and 3 words that end at each token. ``first``: whether it begins a document,
    before which is the start; such a token ends no n-gram of 3."""
    before = np.concatenate((h[:1], h[:-1]))
    before[first] = START
    pair = before * _A + h
    last = np.concatenate((pair[:1], pair[:-1]))
    return _mixed(pair, 2, width), _mixed(last * _B + h, 3, width)


class Chunk:
    """Some documents as hashes of words: their distinct ``words``, and ``keys`` of longer n-grams, in order; and which
    each token's are: ``word_at`` and ``at`` (for all tokens, then for those of ``third``)."""

    def __init__(self, vocabulary: bytes, tokens: bytes, sizes: bytes, train: bytes, width: int) -> None:
        words, no = np.cumsum(_unpack(vocabulary)), _unpack(tokens)
        self.sizes, self.train = _unpack(sizes).astype(np.int64), np.frombuffer(train, bool)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.n, self.width = len(no), width
        first = np.zeros(self.n, bool)
        first[self.begin] = True
        self.third = np.flatnonzero(~first)
        order = np.argsort(words)
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        self.words, self.word_at = words[order], place[no]
        pair, triple = ngrams(words[no], first, width)
        keys = np.concatenate((pair, triple[self.third]))
        del no, pair, triple  # a chunk is the largest thing that a worker holds
        self.keys, at = np.unique(keys, return_inverse=True)
        self.at = at.astype(np.int32)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each word and key in training."""
        train = np.repeat(self.train, self.sizes)
        words = np.bincount(self.word_at[train], minlength=len(self.words))
        return words, np.bincount(self.at[np.concatenate((train, train[self.third]))], minlength=len(self.keys))

    def parts(self, bits: int) -> Iterator[tuple[int, slice, slice]]:
        """Where the words and keys of each part are."""
        each = [[0, *np.searchsorted(x, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)).tolist(), len(x)] for x, width in ((self.words, WORD), (self.keys, self.width))]
        for p, (a, b, c, d) in enumerate(zip(each[0][:-1], each[0][1:], each[1][:-1], each[1][1:], strict=True)):
            if a < b or c < d:
                yield p, slice(a, b), slice(c, d)


class Automaton:
    """The states and arcs that the texts of a chunk touch, in the order in which they do: for each token, the arcs
    from the states of two words, one word and none before it (1 where there is no arc), the failure arcs of the
    first two, and ``state``: how many words its longest seen history has, once it is read."""

    def __init__(self, chunk: Chunk, words: np.ndarray, longer: np.ndarray, n: int, v: int, starts: int, priors: tuple[float, float]) -> None:
        c, three = longer.astype(np.float64)[chunk.at], np.zeros(chunk.n)
        one, two = words.astype(np.float64)[chunk.word_at], c[: chunk.n]
        three[chunk.third] = c[chunk.n :]
        seen_one = np.concatenate((one[:1], one[:-1]))
        seen_one[chunk.begin] = starts
        seen_two = np.concatenate((two[:1], two[:-1]))
        seen_two[chunk.begin] = 0
        root = (one + ADD) / (n + ADD * (v + 1))
        p_two = (two + priors[0] * root) / (seen_one + priors[0])
        p_three = (three + priors[1] * p_two) / (seen_two + priors[1])
        log = lambda p, has: np.where(has, np.log10(p), 1.0)
        self.known, self.root = one > 0, np.log10(root)
        self.two, self.fail_two = log(p_two, two > 0), np.log10(priors[0] / (seen_one + priors[0]))
        self.three, self.fail_three = log(p_three, three > 0), np.log10(priors[1] / (seen_two + priors[1]))
        self.state = np.where(two > 0, 2, np.where(one > 0, 1, 0))
        self.start = 1 if starts else 0

    def score(self, begin: int, end: int) -> float:
        """The traversal of one document."""
        total, state = 0.0, self.start
        columns = (self.three, self.fail_three, self.two, self.fail_two, self.root, self.state)
        for three, fail_three, two, fail_two, root, after in zip(*(x[begin:end].tolist() for x in columns), strict=True):
            if state == 2:
                if three <= 0:
                    total += three
                    state = after
                    continue
                total += fail_three
            if state:
                total += two if two <= 0 else fail_two + root
            else:
                total += root
            state = after
        return total


Numbered = tuple[int, int, list[pa.Array], bytes, bytes, bytes, bytes]


def _numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Numbered]:
    """The chunks of a partition of ``(_rest, text, train)``: number, hash of what is in it, rows of ``_rest``; sizes,
    which are for training, hashes of words and numbers of tokens, all packed."""
    hashes = _Hashes()
    held, train, rest, n, no = [], [], [], 0, TaskContext.get().partitionId() << 33

    def out() -> Numbered:
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        words, at, c = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        order = np.argsort(-c, kind="stable")  # numbers of frequent words are small, and compress
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        data = (_pack(sizes), np.array(train, bool).tobytes(), _pack(np.diff(words[order], prepend=np.uint64(0))), _pack(place[at]))
        mark = xxhash.xxh64()
        for x in data:
            mark.update(x)
        return no, mark.intdigest() - (1 << 63), rest, *data

    for batch in batches:
        begin = 0
        for i, (text, t) in enumerate(zip(batch.column("text"), batch.column("train").to_pylist(), strict=True)):
            w = split(text.as_py())
            h = np.empty(len(w) + 1, np.uint64)
            h[:-1] = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
            h[-1] = END
            held.append(h)
            train.append(bool(t))
            n += len(h)
            if n >= size:
                rest.append(batch.column("_rest").slice(begin, i + 1 - begin))
                yield out()
                held, train, rest, n, begin, no = [], [], [], 0, i + 1, no + 1
        if begin < len(batch):
            rest.append(batch.column("_rest").slice(begin))
    if held:
        yield out()


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """``(chunk, mark, rest, sizes, train, vocabulary, tokens)`` of ``docs (_rest, text, train)``."""
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("chunk", "mark")), T.StructField("rest", T.ArrayType(docs.schema["_rest"].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "train", "vocabulary", "tokens"))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, mark, rest, *data in _numbered(batches, size):
            its = pa.concat_arrays(rest)
            rows = pa.ListArray.from_arrays(pa.array([0, len(its)], pa.int32()), its)
            yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([mark]), rows, *(pa.array([x], pa.binary()) for x in data)], names=schema.names)

    return docs.mapInArrow(number, schema)


def _totals(docs: DataFrame, size: int, bits: int, width: int) -> DataFrame:
    """``(chunk, mark, part, words, longer, v, n, starts)``: the training counts of a chunk's words and longer n-grams in a
    part, over all chunks, in the order of their keys; the last three add up to the numbers of seen words, of training
    tokens and of training documents. There are 2 ** ``bits`` parts."""
    sending = "chunk long, mark long, part long, n long, starts long, words binary, n_words binary, keys binary, n_keys binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, mark, _, sizes, train, vocabulary, tokens in _numbered(batches, size):
            chunk = Chunk(vocabulary, tokens, sizes, train, width)
            n_words, n_keys = chunk.counts()
            gaps = lambda x: _pack(np.diff(x, prepend=np.uint64(0)))
            own = int(chunk.sizes[chunk.train].sum()), int(chunk.train.sum())
            rows = [(no, mark, p, *((0, 0) if i else own), gaps(chunk.words[w]), _pack(n_words[w]), gaps(chunk.keys[k]), _pack(n_keys[k])) for i, (p, w, k) in enumerate(chunk.parts(bits))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 5 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=["chunk", "mark", "part", "n", "starts", "words", "n_words", "keys", "n_keys"])

    def summed(keys: list[bytes], counts: list[bytes]) -> tuple[list[bytes], int]:
        """The total of each key, for each of the lists; and how many keys have one."""
        each = [np.cumsum(_unpack(k)) for k in keys]
        ends = np.cumsum([len(k) for k in each]).tolist()
        _, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, np.concatenate([_unpack(c) for c in counts]).astype(np.float64)).astype(np.uint64)
        return [_pack(total[at[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], int(np.count_nonzero(total))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            chunk, mark, part, n, starts, words, n_words, keys, n_keys = zip(*held, strict=True)
            (to_words, v), (to_keys, _) = summed(words, n_words), summed(keys, n_keys)
            columns = [chunk, mark, part, to_words, to_keys, [v] + [0] * (len(held) - 1), n, starts]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i in (3, 4) else pa.int64()) for i, c in enumerate(columns)], names=["chunk", "mark", "part", "words", "longer", "v", "n", "starts"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][2] != row[2]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    sent = docs.mapInArrow(send, sending)
    return settle(sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, "chunk long, mark long, part long, words binary, longer binary, v long, n long, starts long"))


def score(docs: DataFrame, train: Column, text: str = "text", priors: tuple[float, float] = PRIORS, chunk_tokens: int = 500_000, part_tokens: int = 1_500_000) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``, by the model of
    the rows for which ``train`` is true."""
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rest = [c for c in docs.columns if c not in (text, *results)]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("_rest"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = _chunks(packed, chunk_tokens)
    # sizes alone follow from this: a token for every six bytes, or more in texts of longer words
    size = packed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / 6 + F.count(F.lit(1))).first()[0]
    width = min(64, 18 + int(3 * size).bit_length())
    totals = _totals(packed, chunk_tokens, int(size / part_tokens).bit_length(), width)
    v, n, starts = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "n", "starts"))).first()
    rest_type = chunks.schema["rest"].dataType
    figures = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField("rest", rest_type), *(T.StructField(c, T.ArrayType(k)) for c, k in figures)])

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                of = lambda c, i=i, batch=batch: batch.column(c)[i].as_py()
                chunk = Chunk(*map(of, ("vocabulary", "tokens", "sizes", "train")), width)
                if (replies := of("replies")) is None:
                    raise RuntimeError("the documents were not the same when they were read again: settle them first")
                replies.sort(key=lambda r: r["part"])
                auto = Automaton(chunk, *(np.concatenate([_unpack(r[c]) for r in replies]) for c in ("words", "longer")), n, v, starts, priors)
                ends = (chunk.begin + chunk.sizes).tolist()
                full = [auto.score(a, b) for a, b in zip(chunk.begin.tolist(), ends, strict=True)]
                columns = [chunk.sizes, np.add.reduceat(auto.known, chunk.begin, dtype=np.int64), np.add.reduceat(auto.root, chunk.begin), np.array(full)]
                bounds = pa.array([0, len(full)], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("rest").slice(i, 1), *(pa.ListArray.from_arrays(bounds, pa.array(c)) for c in columns)], names=schema.names)

    replies = totals.groupBy("chunk", "mark").agg(F.collect_list(F.struct("part", "words", "longer")).alias("replies"))
    out = chunks.join(replies, ["chunk", "mark"], "left").mapInArrow(traverse, schema)
    out = out.select(F.explode(F.arrays_zip("rest", *(c for c, _ in figures))).alias("x"))
    return out.select(*(F.col("x.rest")[c].alias(c) for c in rest), "x.n_tokens", "x.n_known", F.lit(n).cast("long").alias("train_tokens"), "x.base_score", "x.score")


def digest(docs: DataFrame, **options) -> DataFrame:
    """Learns from the documents outside fold 0 of 10 and scores all."""
    read = docs.select("doc_id", (fold(folds=10) == 0).alias("held_out"), "text")
    out = score(read, ~F.col("held_out"), **options)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
