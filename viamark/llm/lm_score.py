"""Language-model scoring: a causal self-attention model over subword ids, trained in NumPy.

Tokens are lower-case (A-Z) words of ``[^\\x20\\x09-\\x0D]`` and one end a document. The
base score adds up log10((c + 1) / (N + 1 * (V + 1))) with counts of the training part.
The model sees the subword ids of the same words. It writes P(id | context) as
P(class | context) * P(id | class): one causal attention head over at most ``CONTEXT``
earlier ids predicts which of ``CLASSES`` kinds of id comes next, and counts of all
training words give the id within its kind.

Training: the ids of every training document are cut whole into consecutive windows, so
every id and every end is predicted once, in the window that follows the id before it; what
fills up the last window of a document does not enter the loss. Trainers take about equal
shares, run Adam from common weights, and their weights are averaged by Spark; their number
is bounded, as each one's weights travel. Ids from
``KNOWN_IDS`` on share the embedding of their class.
Scoring: a block of ``STRIDE`` ids is scored with the ``CONTEXT`` ids before it, so windows
overlap and each id is scored once, in batches of equal blocks under one mask.

Scale: words are counted in each task and summed by a shuffle. At most ``HOT_WORDS`` words
can have N / HOT_WORDS occurrences or more; only those are broadcast, and rarer words are
joined by a shuffle, one row per document and word.

Defined cases: a null or empty text is the end alone; a null doc_id counts as an empty one
in the split; without training documents every count is 0 and the weights are the initial
ones; each input row gives one row, repeated rows too; an empty table gives no rows; further
columns of any name are ignored; a text of any length is scored whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viamark.llm.common import ship_package, stage, text_of, with_row_id

FOLDS, HELD_OUT = 7, 2
HOT_WORDS = 500_000
VOCABULARY, END_ID = 50_257, 50_256
END = END_ID.to_bytes(2, "little")
CONTEXT, STRIDE, WIDTH, CLASSES, KNOWN_IDS = 16, 32, 8, 32, 2_048
SPAN = CONTEXT + STRIDE
#: Ids of a training window, windows of a batch, windows that a trainer mixes at once, Adam's rate, rounds, windows of a piece.
WINDOW, BATCH, SHARE, RATE, ROUNDS, PIECE = 33, 64, 16_384, 0.01, 2, 256
#: Windows for which there is a trainer, and trainers at most: beyond that each one sees more windows.
PER_TRAINER, TRAINERS = 65_536, 16_384
#: Blocks that are scored at once.
BLOCKS = 64
FLUSH = 1 << 19
REMEMBERED = 1 << 19
#: Exponents are cut here, far beyond what training reaches, so that sums stay finite.
LARGEST = np.float32(60)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words as bytes; bytes.split() cuts at exactly [\\x20\\x09-\\x0D]."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def held_out(doc_id: str = "doc_id") -> Column:
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == HELD_OUT


class Remembered(dict):
    """Word to its ids as 16-bit numbers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        raw = self[word] = np.array(self.encode(" " + word.decode("utf-8", "replace")), "<u2").tobytes()
        return raw


class Ids:
    """Subword ids of words, each with a space before it."""

    def __init__(self):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

        self.known = Remembered(self.encode)
        self.opens = np.zeros(VOCABULARY, bool)
        self.opens[[i for raw, i in self.ranks.items() if raw[:1] == b" "]] = True

    def learn(self, texts: list[list[bytes]]) -> None:
        """Remember the words of some texts that are new, encoded in one call.

        Of words without any white space only the first id begins with a space. If some word has
        white space of its own, such as U+00A0, none is learnt here and :meth:`each` encodes them one by one.
        """
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*texts).difference(self.known))
        if not new:
            return
        line = b"".join([b" " + w for w in new]).decode("utf-8", "replace")
        if line.split() != line.split(" ")[1:]:
            return
        found = np.array(self.encode(line), "<u2")
        at = (np.flatnonzero(self.opens[found]) * 2).tolist()
        raw = found.tobytes()
        self.known.update(zip(new, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)], strict=True))

    def each(self, words: list[bytes]) -> np.ndarray:
        """The same as :meth:`of` and the end, remembering words: faster over texts, which repeat them."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.frombuffer(b"".join([*map(self.known.__getitem__, words), END]), "<u2")

    def of(self, words: list[bytes]) -> list[int]:
        """One call for all words: the pattern cuts before every space."""
        return self.encode((b" " + b" ".join(words)).decode("utf-8", "replace")) if words else []

    def kinds(self) -> np.ndarray:
        """The class of each id: whether a space comes first, and which kind of byte follows."""
        kind = np.full(VOCABULARY, 15, np.int64)
        for raw, i in self.ranks.items():
            c = (raw[1:] if raw[:1] == b" " and len(raw) > 1 else raw)[0]
            low = c + 32 if 65 <= c <= 90 else c
            kind[i] = 16 * (raw[:1] == b" ") + ((low - 97) // 2 if 97 <= low <= 122 else 13 if 48 <= c <= 57 else 14 if c < 128 else 15)
        return kind


@lru_cache(maxsize=1)
def ids() -> Ids:
    return Ids()


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    return ids().kinds()


@lru_cache(maxsize=1)
def embedded() -> np.ndarray:
    every = np.arange(VOCABULARY)
    return np.where(every < KNOWN_IDS, every, KNOWN_IDS + kinds())


def seen_as(x: np.ndarray) -> np.ndarray:
    """The row of the embedding: frequent ids have their own, others that of their class."""
    return embedded().take(x)


SHAPES = {"e": (KNOWN_IDS + CLASSES, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, CLASSES), "r": (WIDTH, CLASSES), "b": (CLASSES,), "near": (SPAN,)}


def first_weights(seed: int = 17) -> np.ndarray:
    draw = np.random.default_rng(seed)
    parts = [np.zeros(s) if n in ("b", "near") else draw.normal(0, 0.3, s) for n, s in SHAPES.items()]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


STOPS = np.cumsum([int(np.prod(shape)) for shape in SHAPES.values()]).tolist()


def unpack(weights: np.ndarray) -> dict[str, np.ndarray]:
    return {name: weights[start:stop].reshape(shape) for (name, shape), start, stop in zip(SHAPES.items(), [0, *STOPS], STOPS)}


@lru_cache(maxsize=8)
def gaps(t: int) -> tuple[np.ndarray, np.ndarray]:
    """For ids at two places of a window: whether the second comes no later, and how far it lies behind."""
    gap = np.arange(t)[:, None] - np.arange(t)[None, :]
    return gap >= 0, np.clip(gap, 0, SPAN - 1)


def gradient(weights: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Mean loss and gradient for inputs x and target classes y, both (windows, length); targets not ``real`` are left out."""
    p, (n, t), f = unpack(weights), x.shape, weights.dtype.type
    scale, ones = f(WIDTH**-0.5), lambda size: np.ones((size, 1), f)
    (seen, near), top = gaps(t), lambda m: float(max(m.max(), -m.min()))
    at, to, rows = x.ravel(), y.ravel(), n * t
    # Ids with a one at their end, so that one product gives queries, keys, values and the ones that sum the attention.
    e = np.concatenate([p["e"], ones(len(p["e"]))], 1).take(at, 0)
    mix = np.zeros((WIDTH + 1, 3 * WIDTH + 1), f)
    mix[:WIDTH, :-1] = np.concatenate([p["q"] * scale, p["k"], p["v"]], 1)
    mix[WIDTH, -1] = 1
    qkv = (e @ mix).reshape(n, t, 3 * WIDTH + 1)
    q, k, v = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
    a = q @ k.swapaxes(1, 2)
    # Where no exponent can reach LARGEST, the greatest need not be taken off, and what is not seen is cleared afterwards.
    if WIDTH * top(q) * top(k) + top(p["near"]) >= LARGEST:
        a += np.where(seen, p["near"][near], f(-1e9))
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
    else:
        np.exp(a, out=a)
        a *= np.where(seen, np.exp(p["near"])[near], f(0))
    # a stays as it is; what it gives is divided by its sums.
    o = (a @ v).reshape(rows, WIDTH + 1)
    per = 1 / o[:, WIDTH:]
    read, by = np.empty((rows, 2 * WIDTH), f), np.concatenate([p["o"], p["r"]])
    np.multiply(o[:, :WIDTH], per, out=read[:, :WIDTH])
    read[:, WIDTH:] = e[:, :WIDTH]
    z = read @ by
    z += p["b"]
    if top(z) >= LARGEST:
        z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    share = np.full((rows, 1), 1 / rows, f) if real is None else (real.reshape(rows, 1) / max(1, np.count_nonzero(real))).astype(f)
    sums, place = z @ ones(CLASSES), np.arange(0, rows * CLASSES, CLASSES) + to
    right = z.ravel().take(place)
    loss = -(np.log(right / sums.ravel()) * share.ravel()).sum()
    dz = z
    dz *= share / sums
    dz.ravel()[place] -= share.ravel()
    back = dz @ by.T
    do = np.empty((rows, WIDTH + 1), f)
    np.multiply(back[:, :WIDTH], per, out=do[:, :WIDTH])
    np.negative(np.einsum("ij,ij->i", do[:, :WIDTH], read[:, :WIDTH]), out=do[:, WIDTH])
    do = do.reshape(n, t, WIDTH + 1)
    ds = do @ v.swapaxes(1, 2)
    ds *= a
    d = np.empty((n, t, 3 * WIDTH), f)
    d[..., :WIDTH] = ds @ k
    # q has been scaled already.
    d[..., WIDTH : 2 * WIDTH] = ds.swapaxes(1, 2) @ q
    d[..., 2 * WIDTH :] = a.swapaxes(1, 2) @ do[..., :WIDTH]
    d = d.reshape(rows, 3 * WIDTH)
    de = d @ mix[:WIDTH, :-1].T
    de += back[:, WIDTH:]
    of_read = read.T @ dz
    g = dict(zip("qkv", np.split(read[:, WIDTH:].T @ d, 3, 1))) | {"o": of_read[:WIDTH], "r": of_read[WIDTH:], "b": (ones(rows).T @ dz)[0]}
    g["q"] = g["q"] * scale
    g["e"] = np.bincount((at[:, None] * WIDTH + np.arange(WIDTH)).ravel(), de.ravel(), p["e"].size)
    g["near"] = np.bincount(near.ravel(), ds.sum(0).ravel(), SPAN)
    return float(loss), np.concatenate([g[name].ravel() for name in SHAPES]).astype(np.float32)


class Adam:
    """Training that goes on from one set of windows to the next."""

    def __init__(self, weights: np.ndarray):
        self.w, self.m, self.s, self.step = weights.copy(), np.zeros_like(weights), np.zeros_like(weights), 0

    def over(self, windows: np.ndarray) -> np.ndarray:
        """Once over the windows (rows of WINDOW ids) in the order given; what follows a text's end is no target."""
        real = np.ones((len(windows), windows.shape[1] - 1), bool)
        real[:, 1:] = windows[:, 1:-1] != END_ID
        for at in range(0, len(windows), BATCH):
            part = windows[at : at + BATCH]
            _, g = gradient(self.w, seen_as(part[:, :-1]), kinds().take(part[:, 1:]), real[at : at + BATCH])
            self.step += 1
            self.m += 0.1 * (g - self.m)
            g *= g
            self.s += 0.01 * (g - self.s)
            # The corrections of both means are numbers, so they are worked into the rate.
            late = (1 - 0.99**self.step) ** 0.5
            self.w -= RATE * late / (1 - 0.9**self.step) * self.m / (np.sqrt(self.s) + 1e-6 * late)
        return self.w


def train(weights: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return Adam(weights).over(windows)


class Scorer:
    """log10 P of every id of many texts, by overlapping blocks."""

    def __init__(self, weights: np.ndarray, within: np.ndarray):
        p = unpack(weights)
        q, k = p["e"] @ p["q"] * np.float32(WIDTH**-0.5), p["e"] @ p["k"]
        rest = p["e"] @ p["r"] + p["b"]
        # A column of ones sums the attention in the same product.
        v = np.concatenate([p["e"] @ p["v"], np.ones((len(p["e"]), 1), np.float32)], 1)
        self.ones = np.ones(CLASSES, np.float32)
        longest = lambda m, axis: float(np.sqrt((m * m).sum(axis)).max())
        # Where no exponent can reach LARGEST, it need not be cut.
        self.cut_s = longest(q, 1) * longest(k, 1) + float(np.abs(p["near"]).max()) >= LARGEST
        self.cut_z = longest(v[:, :WIDTH], 1) * longest(p["o"], 0) + float(np.abs(rest).max()) >= LARGEST
        # What an id gives when it asks, and when it is asked; both are looked up at once.
        self.asks, self.told = np.concatenate([q, rest], 1), np.concatenate([k, v], 1)
        self.o, self.within = p["o"], within
        gap = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(SPAN)[None, :]
        near = p["near"][np.clip(gap, 0, SPAN - 1)]
        self.mask = np.where(gap >= 0, near if self.cut_s else np.exp(near), np.float32(-1e9 if self.cut_s else 0)).astype(np.float32)

    def score(self, texts: list) -> np.ndarray:
        """The sum for each text; ``texts`` are ids, each with its end id."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        y = np.concatenate([np.asarray(t) for t in texts]).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        x = np.empty_like(y)
        x[1:] = y[:-1]
        x[start] = END_ID
        x = seen_as(x)
        kind = kinds().take(y)
        n = -(-sizes // STRIDE)
        doc = np.repeat(np.arange(len(texts)), n)
        j = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin, stop = start[doc] + j * STRIDE, (start + sizes)[doc]
        out = np.zeros(len(doc), np.float64)
        for at in range(0, len(doc), BLOCKS):
            b, e = begin[at : at + BLOCKS], stop[at : at + BLOCKS]
            place = b[:, None] + np.arange(-CONTEXT, STRIDE)
            keys = x.take(place, mode="clip")
            place = place[:, CONTEXT:]
            asks, told = self.asks.take(keys[:, CONTEXT:], 0), self.told.take(keys, 0)
            s = np.matmul(asks[..., :WIDTH], told[..., :WIDTH].swapaxes(1, 2))
            if self.cut_s:
                s += self.mask
                np.minimum(s, LARGEST, out=s)
                np.exp(s, out=s)
            else:
                np.exp(s, out=s)
                s *= self.mask
            s[j[at : at + BLOCKS] == 0, :, :CONTEXT] = 0
            o = np.matmul(s, told[..., WIDTH:])
            z = (o[..., :WIDTH] / o[..., WIDTH:]).reshape(-1, WIDTH) @ self.o
            z += asks[..., WIDTH:].reshape(z.shape)
            if self.cut_z:
                np.minimum(z, LARGEST, out=z)
            got = z.ravel().take(np.arange(0, z.size, CLASSES) + kind.take(place, mode="clip").ravel())
            got -= np.log(np.exp(z, out=z) @ self.ones)
            got = got.reshape(place.shape).astype(np.float64)
            got[place >= e[:, None]] = 0
            out[at : at + BLOCKS] = got.sum(1)
        return np.bincount(doc, out, len(texts)) / np.log(10) + np.add.reduceat(self.within[y], start)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a task's texts; the end is the empty word."""

    def flushed(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    c: Counter = Counter()
    for b in batches:
        for text in b["text"].to_pylist():
            c.update(words_of(text))
            if len(c) > FLUSH:
                yield flushed(c)
                c = Counter()
        c[b""] += b.num_rows
    yield flushed(c)


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and their counts to counts of subword ids; words of equal count are encoded together."""
    total, get = np.zeros(VOCABULARY, np.int64), ids()
    for b in batches:
        same: dict[int, list[bytes]] = {}
        for word, n in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True):
            if word:
                same.setdefault(n, []).append(word)
            else:
                total[END_ID] += n
        for n, words in same.items():
            np.add.at(total, get.of(words), n)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])


def windows_of(piece: np.ndarray) -> np.ndarray:
    """Ids, the first one as context only, to rows of WINDOW ids that overlap by one; the last is filled up with ends."""
    step = WINDOW - 1
    n = -(-(len(piece) - 1) // step)
    filled = np.full(n * step + 1, END_ID, np.uint16)
    filled[: len(piece)] = piece
    return filled[np.arange(n)[:, None] * step + np.arange(WINDOW)]


def _pieces(turn: int):
    """The pieces of round ``turn``: at most PIECE windows of a text and the id before them."""
    size = PIECE * (WINDOW - 1) * 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, key in zip(b["ids"].to_pylist(), b["key"].to_pylist(), strict=True):
                whole = END + raw
                out += [whole[at * size : (at + 1) * size + 2] for at in range((turn - key) % ROUNDS, -(-len(raw) // size), ROUNDS)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["piece"])

    return work


def _trainer(weights: np.ndarray):
    """Windows are mixed SHARE at a time, so a trainer's memory does not grow with what it sees."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adam, held, n = Adam(weights), [], 0

        def flush() -> None:
            adam.over(np.frombuffer(b"".join(sorted(held, key=zlib.crc32)), np.uint16).reshape(-1, WINDOW).astype(np.int64))
            held.clear()

        for b in batches:
            for raw in b["piece"].to_pylist():
                own = [row.tobytes() for row in windows_of(np.frombuffer(raw, "<u2"))]
                held += own
                n += len(own)
                if len(held) >= SHARE:
                    flush()
        if held:
            flush()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([adam.w.astype(np.float64)], pa.list_(pa.float64()))], names=["n", "weights"])

    return work


def fit(training: DataFrame, seed: int = 17) -> np.ndarray:
    """Weights after ROUNDS rounds of averaged training; training: columns ids (16-bit, each text with its end), key."""
    n = training.agg(F.coalesce(F.sum(F.ceil(F.octet_length("ids") / (2 * (WINDOW - 1)))), F.lit(0))).first()[0]
    weights = first_weights(seed)
    trainers = max(1, min(TRAINERS, -(-n // (PER_TRAINER * ROUNDS))))
    for r in range(ROUNDS):
        mine = training.mapInArrow(_pieces(r), "piece binary").repartition(trainers)
        trained = mine.mapInArrow(_trainer(weights), "n long, weights array<double>")
        each = trained.select("n", F.posexplode("weights").alias("i", "w")).groupBy("i").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))
        if got := each.orderBy("i").collect():  # as many rows as the model has weights
            weights = np.array([x.w for x in got], np.float32)
    return weights


ENCODED = "row_id long, doc_id long, held_out boolean, n_tokens long, known long, base double, ids binary, rare array<binary>, times array<int>"
PASSED = ["row_id", "doc_id", "held_out", "n_tokens", "known", "base"]


def score(docs: DataFrame, seed: int = 17, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    d = docs.select("doc_id", text_of().alias("text"), held_out().alias("held_out"))
    training = d.where(~F.col("held_out"))
    counts = training.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = stage(counts.where("c > 0"), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    floor = max(1, -(-tokens // hot_words))
    # At most hot_words rows: words with tokens / hot_words occurrences or more.
    hot = {bytes(r.word): float(r.l) for r in counts.where(F.col("c") >= floor).select("word", F.log10(F.col("c") + 1).alias("l")).toLocalIterator()}
    shared = spark.sparkContext.broadcast(hot)

    by_id = np.zeros(VOCABULARY)
    # At most as many rows as there are subword ids.
    for r in counts.select("word", F.col("c").alias("n")).mapInArrow(_id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        by_id[r.id] = r.n
    kind = kinds()
    sums, sizes = np.bincount(kind, by_id, CLASSES), np.bincount(kind, minlength=CLASSES)
    within = np.log10((by_id + 1) / (sums + sizes)[kind])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, get = shared.value, ids()
        end = known.get(b"")
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                texts, n, hits, base, rare, times = [], [], [], [], [], []
                split = list(map(words_of, b["text"].to_pylist()))
                get.learn(split)
                for words in split:
                    texts.append(get.each(words).tobytes())
                    values = list(map(known.get, words))
                    c = Counter([w for w, v in zip(words, values, strict=True) if v is None])
                    if end is None:
                        c[b""] += 1
                    values = [v for v in values if v is not None]
                    n.append(len(words) + 1)
                    hits.append(len(values) + (end is not None))
                    base.append(sum(values) + (end or 0.0))
                    rare.append(list(c.keys()))
                    times.append(list(c.values()))
                cols = [b["row_id"], b["doc_id"], b["held_out"], pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(texts, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*PASSED, "ids", "rare", "times"])

    encoded = stage(with_row_id(d).mapInArrow(work, ENCODED), "encoded")
    weights = fit(encoded.where(~F.col("held_out")).select("ids", F.xxhash64(F.lit(seed), "doc_id", "ids").alias("key")), seed)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, within)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                found = scorer.score([np.frombuffer(raw, "<u2") for raw in b["ids"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*[b[c] for c in PASSED], pa.array(found, pa.float64())], names=[*PASSED, "score"])

    scored = stage(encoded.select(*PASSED, "ids").mapInArrow(scores, ENCODED.split(", ids")[0] + ", score double"), "scored")
    pairs = encoded.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_id", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    matched = pairs.join(counts.where(F.col("c") < floor).hint("merge"), "word")
    more = matched.groupBy("row_id").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_base"), F.sum("times").alias("more_known"))
    per_token = float(np.log10(tokens + distinct + 1))
    return scored.join(more.hint("merge"), "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), "score",
    )
