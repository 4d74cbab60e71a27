"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: Characters of texts, and n-grams, that are worked on at a time: two Python workers share an executor's memory with its heap.
PIECE, BLOCK = 1 << 17, 1 << 16
#: Learning texts held as n-grams at a time.
STEP = 50
#: Odd multipliers of the n-gram hash.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
UNKNOWN = "und"


def codewords(classes: int):
    """A row of +1 and -1 for each class. Up to 6 classes: every split in two parts, once; beyond: random splits, rows far apart."""
    import numpy as np

    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 6:
        splits = [[1] + [1 if s >> k & 1 else -1 for k in range(classes - 1)] for s in range(2 ** (classes - 1) - 1)]
        return np.array(splits, dtype=float).T
    rng, bits, best = np.random.default_rng(5), 4 * int(np.ceil(np.log2(classes))) + 3, None
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], size=(classes, bits))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        near = (code @ code.T - 2 * code.shape[1] * np.eye(classes)).max()
        if best is None or near < best[0]:
            best = (near, code)
    return best[1]


def _letters(texts: list[str]):
    """Lower-cased letters and single spaces of the texts, and for each the number of its text; each text ends with a space, whatever follows it. Read in pieces, so that long texts need about 20 bytes a character."""
    import numpy as np

    table = _folded()
    joined = "".join(t + "\x00" for t in texts)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    some, owners, last = [], [], (0, -1)
    for a in range(0, len(joined), PIECE):
        z = min(a + PIECE, len(joined))
        raw = np.frombuffer(joined[a:z].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low, high = np.searchsorted(ends, (a, z - 1), side="right")
        owner = np.repeat(np.arange(low, high + 1, dtype=np.int32), np.diff(np.minimum(ends[low : high + 1], z), prepend=a))
        c = np.where(raw < len(table), table[np.minimum(raw, len(table) - 1)], raw)
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = ~((c[1:] == 32) & (c[:-1] == 32) & (owner[1:] == owner[:-1]))
        keep[0] = (c[0], owner[0]) != last or c[0] != 32
        last = (c[-1], owner[-1])
        some.append(c[keep])
        owners.append(owner[keep])
    return np.concatenate(some or [np.zeros(0, dtype=np.uint32)]), np.concatenate(owners or [np.zeros(0, dtype=np.int32)])


def gram_blocks(texts: list[str]) -> Iterator[tuple]:
    """n-gram buckets (1 to 3 characters) of lower-cased texts and, for each, the number of its text, at most BLOCK at a time: first all of one character, then of two, then of three. White space runs count as one space.

    Digits and marks count as white space, so that a text is judged by its letters alone.
    """
    import numpy as np

    letters, owner = _letters(texts)
    for n in (1, 2, 3):
        for a in range(0, len(letters) - n + 1, BLOCK):
            z = min(a + BLOCK, len(letters) - n + 1)
            c, first = letters[a : z + n - 1].astype(np.uint64), owner[a:z]
            h = np.zeros(z - a, dtype=np.uint64)
            for k in range(n):
                h = (h + c[k : z - a + k]) * np.uint64(_MULTIPLIERS[k])
                h ^= h >> np.uint64(15)
            own = first == owner[a + n - 1 : z + n - 1] if n > 1 else c != 32
            if own.any():
                yield ((h + np.uint64(n)) & np.uint64(BUCKETS - 1))[own].astype(np.int64), first[own].astype(np.int64)


def grams(texts: list[str]):
    """All of gram_blocks() at once."""
    import numpy as np

    out = list(gram_blocks(texts))
    return tuple(np.concatenate([x[k] for x in out] or [np.zeros(0, dtype=np.int64)]) for k in range(2))


_TABLE = None


def _folded():
    """Code point -> lower-case letter, or space if it is no letter; below the surrogates."""
    global _TABLE
    if _TABLE is None:
        import numpy as np

        _TABLE = np.array([(ord(ch.lower()) if len(ch.lower()) == 1 else k) if (ch := chr(k)).isalpha() else 32 for k in range(0xD800)], dtype=np.uint32)
    return _TABLE


@dataclass
class Model:
    """labels[k] has codeword code[k]; bit b of a text: mean over its n-grams of weights[:, b], plus bias, times scale."""

    labels: list[str]
    code: object
    weights: object
    scale: object
    bias: object
    trust: object

    def margins(self, texts: list[str]):
        """Blocks of n-grams go on adding to what the blocks before have, so that their size changes no sum, not even its last bit."""
        import numpy as np

        weights = np.ascontiguousarray(self.weights.T)
        count, total = np.zeros(len(texts), dtype=np.int64), np.zeros((len(weights), len(texts)))
        for bucket, owner in gram_blocks(texts):
            here = slice(owner[0], owner[-1] + 1)
            own = np.concatenate([np.arange(owner[-1] + 1 - owner[0]), owner - owner[0]])
            count[here] += np.bincount(own) - 1
            for w, t in zip(weights, total):
                t[here] = np.bincount(own, weights=np.concatenate([t[here], w[bucket]]))
        return np.ascontiguousarray(total.T) / np.maximum(count, 1)[:, None] * self.scale + self.bias

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Label, score and whether the choice is ambiguous, for each text; whole texts, about PIECE characters at a time."""
        labels, scores, doubts = [], [], []
        some: list[str] = []
        size = 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size > PIECE:
                for out, new in zip((labels, scores, doubts), self._predict(some)):
                    out += new
                some, size = [], 0
        for out, new in zip((labels, scores, doubts), self._predict(some) if some else ((), (), ())):
            out += new
        return labels, scores, doubts

    def _predict(self, texts: list[str]):
        import numpy as np

        if not self.labels:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        m = self.margins(texts)
        # loss of a class: its bits' logistic losses, each weighed by the bit's accuracy on learning texts
        loss = np.stack([(np.logaddexp(0, -m * row) * self.trust).sum(axis=1) for row in self.code], axis=1)
        p = np.exp(loss.min(axis=1)[:, None] - loss)
        p /= p.sum(axis=1)[:, None]
        best, ordered = loss.argmin(axis=1), np.sort(p, axis=1)
        unsure = ordered[:, -1] - (ordered[:, -2] if p.shape[1] > 1 else 0) < 0.2
        letters = [any(map(str.isalpha, t)) for t in texts]
        pick = [self.labels[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters)]
        return pick, [float(x) if ok else 0.0 for x, ok in zip(p.max(axis=1).tolist(), letters)], [bool(u) or not ok for u, ok in zip(unsure.tolist(), letters)]


def train(rows: list[tuple[str, str]], code=None) -> Model:
    """Learn from (text, label) rows: for each bit, naive Bayes log-odds of hashed n-grams, then a logistic scale and bias."""
    import numpy as np

    rows = [(t, x) for t, x in rows if t and any(map(str.isalpha, t))]
    labels = sorted({x for _, x in rows})
    if not labels:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.ones(1), np.zeros(1), np.ones(1))
    code = codewords(len(labels)) if code is None else code
    of = {x: k for k, x in enumerate(labels)}
    y = np.array([of[x] for _, x in rows])
    counts = np.zeros((len(labels), BUCKETS))
    for k in range(0, len(rows), STEP):
        bucket, owner = grams([t for t, _ in rows[k : k + STEP]])
        np.add.at(counts, (y[k : k + STEP][owner], bucket), 1.0 / np.maximum(np.bincount(owner), 1)[owner])
    counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
    weights = np.zeros((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        plus, minus = counts[code[:, b] > 0], counts[code[:, b] < 0]
        if len(plus) and len(minus):
            weights[:, b] = np.clip(np.log((plus.mean(axis=0) + 1e-5) / (minus.mean(axis=0) + 1e-5)), -6, 6)
    model = Model(labels, code, weights, np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    m = np.concatenate([model.margins([t for t, _ in rows[k : k + STEP]]) for k in range(0, len(rows), STEP)])
    target = code[y]
    share = np.bincount(y, minlength=len(labels))
    w = (1.0 / share[y])[:, None]
    scale, bias = np.full(code.shape[1], 5.0), np.zeros(code.shape[1])
    for _ in range(300):
        g = -target / (1 + np.exp(np.clip(target * (m * scale + bias), -50, 50))) * w
        scale -= 20 * ((g * m).sum(axis=0) / w.sum())
        bias -= 2 * (g.sum(axis=0) / w.sum())
        scale = np.clip(scale, 1.0, 60.0)
    right = ((m * scale + bias) * target > 0).mean(axis=0)
    trust = np.log(np.clip(right, 0.5, 1 - 1e-3) / (1 - np.clip(right, 0.5, 1 - 1e-3))) + 0.1
    return Model(labels, code, weights.astype(np.float32), scale, bias, trust / trust.max())


def learning_sample(docs: DataFrame, per_language: int = 400, total: int = 40_000, longest: int = 50_000, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> list[tuple[str, str]]:
    """About per_language labelled whole texts of every label, fewer where all labels together would have more than about `total`; taken by a hash of doc_id.

    Only rows with text, label and crc32(doc_id as text) mod 4 other than 2; texts above `longest` characters only for labels that have no other.
    Shares come from exact counts of labels. Every label is learned, one text of it at least being likely.
    """
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL AND coalesce(crc32(cast(cast(d AS string) AS binary)), 0) % 4 <> 2")
    short = F.length("t") <= longest
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.count_if(short).alias("short")).collect()
    if not counts:
        return []
    each = max(8, min(per_language, total // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, each / (r["short"] or r["n"])))])
    only_short = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], r["short"] > 0)])
    some = rows.where((short | ~only_short[F.col("l")]) & (F.pmod(F.xxhash64("d", F.lit(3)), F.lit(1 << 40)) < share[F.col("l")] * (1 << 40)))
    return sorted((r["t"], r["l"]) for r in some.select("t", "l").collect())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous; all by the text alone, in one pass without a shuffle.

    `und` and ambiguous if the text is null or has no letter, or if nothing was learned. Columns of docs stay, even those
    with the three names, which are replaced.
    """
    new = ("lang_pred", "score", "ambiguous")
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, scores, doubts = shared.value.predict(t.as_py() for t in b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())], names=[*kept, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(predict, schema + ", lang_pred string, score double, ambiguous boolean")


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def language_predictions(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row of docs, by a model learned from its labelled rows.

    Null texts and those without a letter are `und`, score 0 and ambiguous, and so are all if no row can be learned from. A null doc_id is not held out.
    Repeated rows get equal predictions; other columns are ignored. An empty table gives an empty result.
    """
    model = train(learning_sample(docs, **options))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def drop_unidentified(docs: DataFrame, **options) -> DataFrame:
    """docs without rows whose language is undetermined or ambiguous; columns unchanged, whatever their names.

    Null texts and those without a letter go. Repeated rows stay or go together. An empty table gives an empty result.
    """
    model = train(learning_sample(docs, **options))
    text = min(range(len(docs.columns)), key=lambda k: (docs.columns[k] != "text", docs.columns[k].lower() != "text"))
    found = identify(docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)]), model, f"_{text}")
    return found.where("NOT ambiguous").select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])
