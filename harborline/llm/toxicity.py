"""A convolutional text classifier for toxicity, trained in numpy.

A word's vector is the sum of two rows of a hashed embedding table, so two words that share one
row still differ. Filters of several widths run over the word vectors, a rectifier and a max
pool over the whole text follow, and a logistic output gives the score. Training is mini-batch
descent with Adagrad; as only a filter's largest place has a gradient, updates are sparse. The
first column of the table starts from how strongly a word's presence goes with the label in the
training rows.

The classifier is fitted on all labelled rows outside the held-out fold (``labelled_rows``): up to
``TRAIN_ROWS`` of them in one task, more in pieces whose changes are averaged after every epoch (see
``train``). A quarter of them is left out of the fit and calibrates, for each
language, the score from which a text is rejected; languages with few toxic rows there use the
threshold over all languages. Scores depend on the text only. Scoring covers every row and whole texts.
``training_rows`` is a bounded selection for callers that want one; no query uses it.

Defined results: a null or empty text gets the score of a text without words; a null language
has the common threshold; repeated rows score alike; labels that are null are ignored, and of
several labels for an id the largest counts. Without any labelled row every score is 0. Other
columns pass through.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.tables import add_columns, bucketed, written
from harborline.llm.words import word_hashes

#: Rows, about, that one task fits at a time; also the bound of ``training_rows``.
TRAIN_ROWS = 12_000
#: Bytes of their texts, about; of ``training_rows`` also the bounds on the bytes, together and each.
TRAIN_BYTES = 128 * 1024 * 1024
TRAIN_TEXT_BYTES = 1024 * 1024
#: Bits of the filter of ids before the labelled texts are shuffled.
KEY_BITS = 1 << 25
BUCKETS = 1 << 17
DIMENSIONS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 8
BATCH = 64
RATE = 0.05
#: Toxic calibration rows that a language needs for a threshold of its own.
LANGUAGE_ROWS = 20
PREDICT_AT = 0.3
#: Changes of parameters are added up in whole numbers of this.
UNIT = 2.0**-36


def fold(id_column: str = "doc_id", modulus: int = 4) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def buckets(text: str) -> np.ndarray:
    """Two rows of the table for each word, then empty rows so that filters don't reach the next
    text. Row 0 is the empty one."""
    h = word_hashes(text)
    out = np.zeros((len(h) + max(WIDTHS), 2), np.int32)
    out[: len(h), 0] = h % np.uint64(BUCKETS - 1) + np.uint64(1)
    out[: len(h), 1] = (h >> np.uint64(24)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return out


class Classifier:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.table[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, :] = np.abs(f[:, 0, :])
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.offset = np.float32(0)
        self.thresholds: dict[str, float] = {}
        self.common = PREDICT_AT

    def _pooled(self, rows: list[np.ndarray]):
        """Word vectors, starts of the texts, and each filter's largest value and its place."""
        places = np.concatenate(rows)
        starts = np.cumsum([0, *(len(r) for r in rows[:-1])])
        x = self.table[places[:, 0]] + self.table[places[:, 1]]
        values, tops = [], []
        for f, b in zip(self.filters, self.bias):
            width, n = len(f), len(x) - len(f) + 1
            y = x[:n] @ f[0]
            for j in range(1, width):
                y += x[j : n + j] @ f[j]
            # A window may start at a text's words or its first empty row; from the later ones
            # it would reach the next text.
            late = np.concatenate([starts[1:], [len(x)]])[:, None] - np.arange(1, max(WIDTHS))
            late = late.ravel()
            y[late[late < n]] = -np.inf
            cut = starts
            best = np.maximum.reduceat(y, cut, axis=0)
            values.append(np.maximum(best + b, 0))
            tops.append((y, best, cut))
        return places, x, starts, values, tops

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        values = self._pooled(rows)[3]
        z = np.concatenate(values, axis=1) @ self.out + self.offset
        # Six digits: what the size of a batch changes in the sums lies beyond them.
        return np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40))), 6)

    @staticmethod
    def presence(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many texts a table row is present, and in how many toxic ones."""
        seen, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for r, label in zip(rows, labels):
            present = np.unique(r)
            seen[present] += 1
            toxic[present] += int(label)
        return seen, toxic

    def start(self, seen: np.ndarray, toxic: np.ndarray, share: float) -> None:
        """The first column: the z-score of a table row's presence against the label, scaled."""
        seen, toxic, share = seen.astype(np.float32), toxic.astype(np.float32), np.float32(share)
        z = (toxic - share * seen) / np.sqrt(seen * share * (1 - share) + 1)
        self.table[:, 0] = np.clip(z, 0, 20) / 10
        self.table[0] = 0
        self.offset = np.float32(np.log(share / (1 - share)))
        self.sums = [np.full(p.shape, 1e-3, np.float32) for p in (*self.filters, *self.bias, self.out)]
        self.table_sum, self.offset_sum = np.full(BUCKETS, 1e-3, np.float32), 1e-3

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> None:
        self.start(*self.presence(rows, labels), labels.mean())
        rng = np.random.default_rng(seed)
        for epoch in range(EPOCHS):
            self.epoch(rows, labels, rng.permutation(len(rows)))

    def epoch(self, rows: list[np.ndarray], labels: np.ndarray, order: np.ndarray) -> None:
        """One pass over the rows in the given order."""
        parameters = [*self.filters, *self.bias, self.out]
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            places, x, starts, values, tops = self._pooled([rows[i] for i in picked])
            pooled = np.concatenate(values, axis=1)
            z = np.clip(pooled @ self.out + self.offset, -40, 40)
            error = ((1 / (1 + np.exp(-z)) - labels[picked]) / len(picked)).astype(np.float32)
            back = error[:, None] * self.out[None, :] * (pooled > 0)
            grads, touched, moves = [], [], []
            for i, (f, (y, best, cut)) in enumerate(zip(self.filters, tops)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                ends = [*cut[1:], len(y)]
                top = np.stack([a + np.argmax(y[a:e], axis=0) for a, e in zip(cut, ends)])
                grad = np.zeros_like(f)
                for j in range(len(f)):
                    vectors = x[top + j]
                    grad[j] = np.einsum("tfd,tf->df", vectors, g)
                    touched.append(places[(top + j).ravel()])
                    moves.append((g[:, :, None] * f[j].T[None]).reshape(-1, DIMENSIONS))
                grads.append(grad)
            grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(len(WIDTHS))]
            grads.append(pooled.T @ error)
            for p, s, g in zip(parameters, self.sums, grads):
                s += g * g
                p -= RATE * g / np.sqrt(s)
            self.offset_sum += float(error.sum()) ** 2
            self.offset -= np.float32(RATE * error.sum() / np.sqrt(self.offset_sum))
            move, place = np.concatenate(moves), np.concatenate(touched)
            for side in (0, 1):
                own, inverse = np.unique(place[:, side], return_inverse=True)
                total = np.zeros((len(own), DIMENSIONS), np.float32)
                np.add.at(total, inverse, move)
                self.table_sum[own] += (total * total).mean(axis=1)
                self.table[own] -= RATE * total / np.sqrt(self.table_sum[own])[:, None]
            self.table[0] = 0

    def state(self) -> np.ndarray:
        """All that an epoch changes, in rows of ``DIMENSIONS`` numbers: the table and its sums first."""
        dense = [*self.filters, *self.bias, self.out, *self.sums, np.array([self.offset, self.offset_sum])]
        flat = np.concatenate([np.ravel(x).astype(np.float64) for x in dense])
        flat = np.pad(flat, (0, -len(flat) % DIMENSIONS))
        return np.concatenate([self.table.astype(np.float64).ravel(), self.table_sum.astype(np.float64), flat]).reshape(-1, DIMENSIONS)

    def restore(self, state: np.ndarray, offset_sum: float | None = None) -> None:
        flat, at = state.ravel(), 0

        def take(shape) -> np.ndarray:
            nonlocal at
            size = int(np.prod(shape))
            at += size
            return flat[at - size : at].reshape(shape).astype(np.float32)

        self.table, self.table_sum = take(self.table.shape), take(BUCKETS)
        shapes = [p.shape for p in (*self.filters, *self.bias, self.out)]
        values = [take(s) for s in shapes]
        n = len(WIDTHS)
        self.filters, self.bias, self.out = values[:n], values[n : 2 * n], values[-1]
        self.sums = [take(s) for s in shapes]
        self.offset, self.offset_sum = np.float32(flat[at]), float(flat[at + 1]) if offset_sum is None else offset_sum

    def calibrate(self, scores: np.ndarray, labels: np.ndarray, languages: list[str | None]) -> None:
        """The threshold with the best F1 over all rows, and for each language with enough rows."""
        self.common = best_threshold(scores, labels)
        for language in {x for x in languages if x is not None}:
            own = np.array([x == language for x in languages])
            if labels[own].sum() >= LANGUAGE_ROWS:
                self.thresholds[language] = best_threshold(scores[own], labels[own])

    def threshold(self, language: str | None) -> float:
        return self.thresholds.get(language, self.common)

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        np.savez_compressed(
            file, table=self.table, out=self.out, rest=np.array([self.offset, self.common]),
            names=np.array([*self.thresholds], dtype=str), levels=np.array([*self.thresholds.values()]),
            **{f"f{i}": f for i, f in enumerate(self.filters)}, **{f"b{i}": b for i, b in enumerate(self.bias)},
        )
        return file.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Classifier:
        model, saved = Classifier.__new__(Classifier), np.load(io.BytesIO(data))
        model.table, model.out = saved["table"], saved["out"]
        model.offset, model.common = np.float32(saved["rest"][0]), float(saved["rest"][1])
        model.thresholds = dict(zip(saved["names"].tolist(), saved["levels"].tolist()))
        model.filters = [saved[f"f{i}"] for i in range(len(WIDTHS))]
        model.bias = [saved[f"b{i}"] for i in range(len(WIDTHS))]
        return model


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score in the middle of the gap at which F1 is largest; ``PREDICT_AT`` without toxic rows."""
    if not labels.any():
        return PREDICT_AT
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # rows of equal scores go together
    i = int(np.argmax(f1))
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = TRAIN_ROWS) -> DataFrame:
    """id, text, lang, toxic of at most ``limit`` labelled rows outside the held-out fold, within the bounds
    on bytes. Rows of the same id and text are one row, with the smallest language; rows are taken by the
    hash of the id, then of the text."""
    own = labels.select(F.col(id_column).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    picked = (
        own.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (fold("id") != 2))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(limit)
    )
    # At most ``limit`` rows of two numbers: a broadcast of bounded size.
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    once = texts.where(size <= TRAIN_TEXT_BYTES).join(F.broadcast(picked), "id").groupBy("id", "text", "toxic").agg(F.min("lang").alias("lang"))
    # An id can have any number of texts, so the limit is kept on rows too.
    order = [F.xxhash64("id"), F.col("id"), F.xxhash64("text"), F.col("text")]
    taken = once.orderBy(*order).limit(limit)
    so_far = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of few rows
    return taken.withColumn("so_far", so_far).where(F.col("so_far") <= TRAIN_BYTES).select("id", "text", "lang", "toxic")


def perhaps_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``keys``, and a few others: those whose hash hits the bit of such a key. A join
    behind it shuffles few rows that it drops. The bits are a broadcast of at most ``KEY_BITS`` / 8 bytes;
    the more keys, the more other rows pass."""
    place = F.pmod(F.xxhash64(key), F.lit(KEY_BITS))
    bits = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )
    placed = rows.withColumn("_place", place).withColumn("_part", F.bitmap_bucket_number("_place"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("getbit", byte, (at % 8).cast("int")) == 1
    return placed.join(F.broadcast(bits), "_part").where(hit).select(*rows.columns)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, text, lang, toxic of all labelled rows outside the held-out fold. Rows of the same id and text
    are one row, with the smallest language."""
    own = labels.select(F.col(id_column).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    picked = own.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (fold("id") != 2)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    # Ids of two types may be equal without being hashed alike.
    if texts.schema["id"].dataType == picked.schema["id"].dataType:
        texts = perhaps_in(texts, picked, "id")
    return texts.join(picked, "id").groupBy("id", "text", "toxic").agg(F.min("lang").alias("lang"))


def train(rows: DataFrame) -> bytes:
    """The classifier, fitted on all the rows (id, text, lang, toxic).

    The rows are dealt by hash to pieces of about ``TRAIN_ROWS`` rows or ``TRAIN_BYTES`` of text, a number
    that follows from the rows alone. A single piece is fitted in one task. Of several, every epoch fits each
    piece by itself from the same state, and the next state takes, for each row of parameters, the mean
    change over the pieces that changed it. What the first column and the thresholds come from is counted over all pieces."""
    # Counted, then read for its features: written, so that finding the rows moves their texts once only.
    rows = written(rows.select("id", "text", "lang", "toxic"), "labelled")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"), F.min("toxic").alias("least"), F.max("toxic").alias("most")).first()
    model = Classifier()
    if total.rows == 0 or total.least == total.most:
        model.out[:] = 0
        model.offset = np.float32(40 if total.rows and total.least else -40)
        return model.to_bytes()
    pieces = max(1, -(-total.rows // TRAIN_ROWS), -(-total.bytes // TRAIN_BYTES))
    piece = F.pmod(F.xxhash64("id", "text"), F.lit(pieces)).cast("int").alias("piece")

    def features(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([buckets(t or "").tobytes() for t in batch.column("text").to_pylist()], pa.binary())]

    data = add_columns(rows.select("*", piece), features, "data binary", "text").drop("text")
    if pieces == 1:
        return bytes(data.groupBy("piece").applyInArrow(_fit_alone, "model binary").first().model)
    # Read once an epoch; the buckets spare a shuffle each time.
    return _fit_pieces(bucketed(data, "toxicity", "piece"), model)


def _parts(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, list[str | None], np.ndarray]:
    """Features, labels and languages of a piece in a fixed order, and which rows calibrate."""
    found = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "data", "lang", "toxic"))), key=lambda x: (x[0], x[1]))
    data = [np.frombuffer(x[1], np.int32).reshape(-1, 2) for x in found]
    return data, np.array([x[3] for x in found], np.float32), [x[2] for x in found], np.arange(len(found)) % 4 == 3


def _fit_alone(table: pa.Table) -> pa.Table:
    data, labels, languages, apart = _parts(table)
    model = Classifier()
    if labels[~apart].min() == labels[~apart].max() or len(data) < 200:
        apart[:] = False
    model.fit([d for d, a in zip(data, apart) if not a], labels[~apart])
    held = apart if apart.any() else ~apart
    scores = np.concatenate([model.scores([d]) for d, h in zip(data, held) if h])
    model.calibrate(scores, labels[held], [x for x, h in zip(languages, held) if h])
    return pa.table({"model": pa.array([model.to_bytes()], pa.binary())})


_COLUMNS = [f"d{i}" for i in range(DIMENSIONS)]


def _epoch_of_piece(shared: Broadcast, offset_sum: float, epoch: int) -> Callable[[pa.Table], pa.Table]:
    def step(table: pa.Table) -> pa.Table:
        rows, labels, _, apart = _parts(table)
        kept = [r for r, a in zip(rows, apart) if not a]
        own = Classifier()
        own.restore(shared.value, offset_sum)
        before = own.state()
        order = np.random.default_rng([7, epoch, table.column("piece")[0].as_py()]).permutation(len(kept))
        own.epoch(kept, labels[~apart], order)
        # Whole numbers of a small unit add up alike in any order.
        moved = np.rint((own.state() - before) / UNIT).astype(np.int64)
        slot = np.flatnonzero(moved.any(axis=1))
        return pa.table({"slot": slot, **{c: moved[slot, i] for i, c in enumerate(_COLUMNS)}})

    return step


def _fit_pieces(data: DataFrame, model: Classifier) -> bytes:
    context = data.sparkSession.sparkContext
    by_piece = data.groupBy("piece")

    def present(table: pa.Table) -> pa.Table:
        rows, labels, _, apart = _parts(table)
        seen, toxic = Classifier.presence([r for r, a in zip(rows, apart) if not a], labels[~apart])
        slot = np.flatnonzero(seen)
        # The slot behind the table counts the rows themselves.
        return pa.table({
            "slot": np.append(slot, BUCKETS), "seen": np.append(seen[slot], (~apart).sum()),
            "toxic": np.append(toxic[slot], int(labels[~apart].sum())),
        })

    # At most one row for each row of the table.
    counted = by_piece.applyInArrow(present, "slot long, seen long, toxic long").groupBy("slot").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow()
    seen, toxic = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    slot, seen_in, toxic_in = (counted.column(c).to_numpy() for c in ("slot", "seen", "toxic"))
    seen[slot], toxic[slot] = seen_in, toxic_in
    # A share of 0 or 1 has no odds.
    share = np.clip(toxic[-1] / seen[-1], 1 / (2 * seen[-1]), 1 - 1 / (2 * seen[-1]))
    model.start(seen[:-1], toxic[:-1], share)
    for epoch in range(EPOCHS):
        state = model.state()
        # The sum of the offset alone has more digits than these.
        shared = context.broadcast(state.astype(np.float32))
        schema = ", ".join(["slot long", *(f"{c} long" for c in _COLUMNS)])
        moves = by_piece.applyInArrow(_epoch_of_piece(shared, model.offset_sum, epoch), schema).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in _COLUMNS)).toArrow()
        slot, n = moves.column("slot").to_numpy(), moves.column("n").to_numpy()
        for i, c in enumerate(_COLUMNS):
            state[slot, i] += moves.column(c).to_numpy().astype(np.float64) * UNIT / n
        model.restore(state)
        shared.destroy()
    fitted = context.broadcast(model.to_bytes())

    def held(table: pa.Table) -> pa.Table:
        rows, labels, languages, apart = _parts(table)
        own = Classifier.from_bytes(fitted.value)
        picked = [i for i in range(len(rows)) if apart[i]]
        return pa.table({
            "lang": pa.array([languages[i] for i in picked], pa.string()),
            "score": pa.array([float(own.scores([rows[i]])[0]) for i in picked], pa.float64()),
            "toxic": pa.array([int(labels[i]) for i in picked], pa.int64()),
        })

    # Scores have six digits, so a language has at most a million of them.
    levels = by_piece.applyInArrow(held, "lang string, score double, toxic long").groupBy("lang", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits")
    )
    every = levels.groupBy("score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(F.lit(None).cast("string").alias("lang"), "score", "n", "hits")
    cuts = levels.where(F.col("lang").isNotNull()).unionByName(every).groupBy("lang").applyInArrow(_cut, "lang string, level double, hits long").collect()
    model.common = next((c.level for c in cuts if c.lang is None), PREDICT_AT)
    model.thresholds = {c.lang: c.level for c in cuts if c.lang is not None and c.hits >= LANGUAGE_ROWS}
    return model.to_bytes()


def _cut(table: pa.Table) -> pa.Table:
    """``best_threshold`` over counted scores."""
    score, n, hits = (table.column(c).to_numpy() for c in ("score", "n", "hits"))
    order = np.argsort(-score)
    s, reached = score[order], np.cumsum(hits[order])
    i = int(np.argmax(2 * reached / (np.cumsum(n[order]) + hits.sum())))
    level = PREDICT_AT if not hits.any() else float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])
    return pa.table({"lang": table.column("lang").slice(0, 1), "level": [level], "hits": [int(hits.sum())]})


_loaded: dict[int, Classifier] = {}


def _classifier(model: Broadcast) -> Classifier:
    key = hash(model.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Classifier.from_bytes(model.value)
    return _loaded[key]


def score(df: DataFrame, model: bytes, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds score, threshold of the row's language and rejected (score at least the threshold)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> list[pa.Array]:
        own = _classifier(shared)
        scores = own.scores([buckets(t or "") for t in batch.column(text).to_pylist()])
        thresholds = np.array([own.threshold(x) for x in batch.column(lang).to_pylist()])
        return [pa.array(scores), pa.array(thresholds), pa.array(scores >= thresholds)]

    return add_columns(df, scored, "score double, threshold double, rejected boolean", text)
