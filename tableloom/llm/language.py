"""Language identification with character language models.

Each language has an interpolated Kneser-Ney model over its letters and word
gaps. Spark counts the grams of the highest order over all labelled texts, and
continuation counts, discounts of each language and order, and probabilities
follow by grouping and joining those counts; no gram is left out. The model
lies in files of sorted hash arrays, each a range of hashes with the entries of
the languages that have seen a gram. Workers map the files they need, so a model
may be larger than a worker. The lowest cross-entropy for each character wins,
and a text whose entropy no language of the labelled texts would show is
rejected.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.columns import free_name
from tableloom.session import materialise, scratch_dir

ORDER = 4
UNKNOWN = "und"
# Grams that a task holds before it hands their counts on.
HELD = 400_000
# Grams whose probabilities for all languages a worker looks up at a time, over the number of languages.
TOGETHER = 1 << 22
# Files of a model that a worker has open.
OPEN = 64
# What the entropies may be multiplied with for the score.
HEATS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
# The share of labelled texts that the calibrated limit may reject.
REJECTED = 0.001

BITS = 16  # of one character in a gram
GAP = 1  # stands for everything between letters, and for both ends


def _letters() -> np.ndarray:
    """The lower-case letter of each code point below 2^16; ``GAP`` for what is not a letter."""
    table = np.full(1 << BITS, GAP, dtype=np.uint64)
    for point in range(1 << BITS):
        c = chr(point)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[point] = low if low < 1 << BITS else point
    return table


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """Lower-case letters with one gap between words and at both ends; empty without letters."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    # Letters beyond 2^16 share the codes of the low bits of their number.
    folded = _TABLE[0][np.minimum(points, (1 << BITS) - 1)]
    high = points >= 1 << BITS
    if high.any():
        folded = folded.copy()
        alpha = np.fromiter((chr(p).isalpha() for p in points[high].tolist()), dtype=bool, count=int(high.sum()))
        folded[high] = np.where(alpha, points[high] & 0xFFFF | 2, GAP)
    keep = folded != GAP
    if not keep.any():
        return np.zeros(0, dtype=np.uint64)
    keep[1:] |= folded[:-1] != GAP  # the first of a run of gaps
    keep[0] &= folded[0] != GAP
    kept = folded[keep]
    parts = [np.full(1, GAP, np.uint64), kept] + ([] if kept[-1] == GAP else [np.full(1, GAP, np.uint64)])
    return np.concatenate(parts)


def grams(s: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each symbol from the second on, its characters from high to low bits.

    Shorter ones at the start are filled with gaps before the first.
    """
    padded = np.concatenate([np.full(order - 2, GAP, np.uint64), s])
    n = len(s) - 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(order):
        out = out << np.uint64(BITS) | padded[k : k + n]
    return out


def count(docs: DataFrame, language: str = "lang", order: int = ORDER) -> DataFrame:
    """``language, gram, n`` over whole texts; counts of a task are summed before they are shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def fold(of: str) -> None:
            if parts := waiting.pop(of, None):
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                old_keys, old_n = held.get(of, (keys[:0], n[:0]))
                both, at = np.unique(np.concatenate([old_keys, keys]), return_inverse=True)
                held[of] = both, np.bincount(at, np.concatenate([old_n, n]), len(both)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for of in list(waiting):
                fold(of)
            for of, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["language", "gram", "n"])
            held.clear()

        for batch in batches:
            for text, of in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = symbols(text.as_py())
                if len(s):
                    waiting.setdefault(of, []).append(grams(s, order))
                    size += len(s)
                    if size > 1 << 21:
                        for name in list(waiting):
                            fold(name)
                        size = 0
                        if sum(len(k) for k, _ in held.values()) > HELD:
                            yield from rows()
        yield from rows()

    known = docs.where(F.col("text").isNotNull() & F.col(language).isNotNull())
    found = known.select(F.col("text").cast("string"), F.col(language).cast("string").alias("language")).mapInArrow(counted, "language string, gram bigint, n bigint")
    return found.groupBy("language", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Part:
    """A file with the entries of the hashes from ``first`` on."""

    path: str
    first: int


@dataclass
class Model:
    """Of each order from 1: files of log probabilities of grams, and of the log weights that contexts give the next lower order.

    A language without an entry has not seen the gram or the context.
    """

    languages: list[str]
    grams: list[list[Part]]
    contexts: list[list[Part]]
    floor: float  # of a character that no language has
    limit: float = np.inf  # cross-entropy from which a text is rejected
    heat: float = 1.0  # what the entropies are multiplied with for the score

    def log_probabilities(self, gram: np.ndarray) -> np.ndarray:
        """A row for each gram of the highest order and a column for each language."""
        order = len(self.grams)
        below, at = np.zeros(1, dtype=np.uint64), np.zeros(len(gram), dtype=np.int64)
        values = np.full((1, len(self.languages)), self.floor)
        for k in range(1, order + 1):
            here, place = np.unique(gram & _mask(k), return_inverse=True)
            values = values[np.searchsorted(below, here & _mask(k - 1))]
            contexts, of = np.unique(here >> np.uint64(BITS), return_inverse=True)
            weights = np.zeros((len(contexts), len(self.languages)))
            row, language, value = _entries(self.contexts[k - 1], contexts)
            weights[row, language] = value
            values += weights[of]
            row, language, value = _entries(self.grams[k - 1], here)
            values[row, language] = value
            below, at = here, place
        return values[at]

    def entropies(self, texts: Sequence[str | None]) -> list[np.ndarray | None]:
        """Cross-entropy for each character and language of every text; ``None`` without letters."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held, size, room = [], 0, max(TOGETHER // max(len(self.languages), 1), 1 << 12)

        def flush() -> None:
            if held:
                every, at = np.unique(np.concatenate([g for _, g, _ in held]), return_inverse=True)
                logs = self.log_probabilities(every)
                end = 0
                for k, g, n in held:
                    # Pieces of a long text are added up.
                    total = -logs[at[end : end + len(g)]].sum(axis=0) / n
                    out[k] = total if out[k] is None else out[k] + total
                    end += len(g)
                held.clear()

        for k, text in enumerate(texts):
            s = symbols(text) if text else np.zeros(0, np.uint64)
            found = grams(s, len(self.grams)) if len(s) else s
            for start in range(0, len(found), room):
                piece = found[start : start + room]
                held.append((k, piece, len(found)))
                size += len(piece)
                if size >= room:
                    flush()
                    size = 0
        flush()
        return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << BITS * order) - 1)


def _mix(gram: np.ndarray) -> np.ndarray:
    """A hash that is one to one, so different grams never share it."""
    x = gram.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


# A file: numbers of hashes and entries, then sorted hashes, the end of the entries of each hash, and languages and values of the entries.
_HEAD = np.dtype("<i8")


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


@functools.lru_cache(maxsize=OPEN)
def _arrays(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The arrays of a file: mapped where the file system allows it, so that memory may let go of them."""
    system, name = _file(path)
    if isinstance(system, fs.LocalFileSystem):
        raw = pa.memory_map(name).read_buffer()
    else:
        with system.open_input_file(name) as file:
            raw = file.read_buffer()
    n, m = np.frombuffer(raw, _HEAD, 2).tolist()
    hashes = np.frombuffer(raw, "<i8", n, 16)
    ends = np.frombuffer(raw, "<i8", n + 1, 16 + 8 * n)
    languages = np.frombuffer(raw, "<i4", m, 24 + 16 * n)
    return hashes, ends, languages, np.frombuffer(raw, "<f4", m, 24 + 16 * n + 4 * m)


def _entries(parts: list[Part], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, language, value`` of all entries of the keys."""
    h = _mix(keys).view(np.int64)
    order = np.argsort(h)
    h = h[order]
    cuts = np.searchsorted(h, np.array([p.first for p in parts[1:]], dtype=np.int64))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))]
    for part, low, high in zip(parts, [0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
        if low < high:
            hashes, ends, languages, values = _arrays(part.path)
            at = np.minimum(np.searchsorted(hashes, h[low:high]), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h[low:high])
            at = at[hit]
            n = ends[at + 1] - ends[at]
            entry = np.repeat(ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append((np.repeat(order[low + hit], n), languages[entry], values[entry]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _stored(entries: DataFrame, key: str, value: str, folder: str) -> list[Part]:
    """Write ``key, language id, value`` to files by ranges of hashes; a file gets its name when it is whole."""
    mixed = F.pandas_udf(lambda g: pd.Series(_mix(g.to_numpy(np.int64).view(np.uint64)).view(np.int64)), "bigint")
    rows = entries.select(mixed(F.col(key)).alias("h"), F.col("id").cast("int").alias("id"), F.col(value).cast("float").alias("v"))
    rows = rows.repartitionByRange("h").sortWithinPartitions("h", "id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if columns:
            h, language, values = (np.concatenate(c) for c in zip(*columns, strict=True))
            hashes, first = np.unique(h, return_index=True)
            ends = np.append(first, len(h)).astype("<i8")
            name = f"{folder}/{uuid.uuid4().hex}"
            system, path = _file(name)
            system.create_dir(_file(folder)[1], recursive=True)
            with system.open_output_stream(path, compression=None) as out:
                for x in (np.array([len(hashes), len(h)], "<i8"), hashes.astype("<i8"), ends, language.astype("<i4"), values.astype("<f4")):
                    out.write(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(hashes[0])], pa.int64())], names=["path", "first"])

    # One row for each file; a task that runs again leaves a file that nothing names.
    found = rows.mapInArrow(write, "path string, first bigint").collect()
    return [Part(r.path, r.first) for r in sorted(found, key=lambda r: r.first)]


def _low(column: str, order: int) -> Column:
    """The last ``order`` characters of a gram."""
    return F.col(column).bitwiseAND(F.lit((1 << BITS * order) - 1)) if order < 4 else F.col(column)


def build(counts: DataFrame, folder: str, order: int = ORDER) -> Model | None:
    """Interpolated Kneser-Ney models from the counts ``language, gram, n`` of the highest order; ``None`` without any.

    A lower order counts the different characters seen before a gram. The
    discount of a language and order is n1 / (n1 + 2 * n2), or 0.5 where one of
    the two is 0. Only the names of the languages and files reach the driver.
    """
    names = sorted(r[0] for r in counts.select("language").distinct().collect())
    if not names:
        return None
    ids = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])
    levels = {order: counts.select(ids[F.col("language")].alias("id"), "gram", F.col("n").cast("double").alias("n"))}
    for k in range(order - 1, 0, -1):
        lower = levels[k + 1].select("id", _low("gram", k).alias("gram"))
        levels[k] = materialise(lower.groupBy("id", "gram").agg(F.count(F.lit(1)).cast("double").alias("n")), f"grams-{k}")
    letters = levels[1].select("gram").distinct().count() + 1
    model = Model(names, [], [], -float(np.log(letters)))
    below = None
    for k in range(1, order + 1):
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discounts = levels[k].groupBy("id").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(F.lit(0.5)).alias("d"))
        rows = levels[k].join(F.broadcast(discounts), "id").withColumn("context", F.shiftrightunsigned("gram", BITS))  # a row for each language
        behind = rows.groupBy("id", "context").agg(F.sum("n").alias("total"), (F.first("d") * F.count(F.lit(1)) / F.sum("n")).alias("gamma"))
        behind = materialise(behind, f"contexts-{k}")
        known = rows.join(behind, ["id", "context"])
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        if below is None:
            known = known.withColumn("lower", F.lit(1.0 / letters))
        else:
            known = known.withColumn("rest", _low("gram", k - 1)).join(below.select("id", F.col("gram").alias("rest"), F.col("p").alias("lower")), ["id", "rest"])
        below = materialise(known.select("id", "gram", (own + F.col("gamma") * F.col("lower")).alias("p")), f"probabilities-{k}")
        model.grams.append(_stored(below.withColumn("log", F.log("p")), "gram", "log", f"{folder}/grams-{k}"))
        model.contexts.append(_stored(behind.withColumn("log", F.log("gamma")), "context", "log", f"{folder}/contexts-{k}"))
    return model


def _shares(e: np.ndarray, heat: float) -> np.ndarray:
    z = np.exp(-heat * (e - e.min(axis=1, keepdims=True)))
    return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, language: str = "lang", order: int = ORDER) -> Model | None:
    """A model of every language of ``docs``; ``None`` without a labelled text that has letters.

    All labelled texts and all their grams count, in the models and in the
    calibration. The files lie in the shared folder of the cluster.
    """
    counts = materialise(count(docs, language, order), "gram-counts")
    model = build(counts, scratch_dir(docs.sparkSession, "language-model"), order)
    if model is not None:
        calibrate(model, docs, language)
    return model


def calibrate(model: Model, docs: DataFrame, language: str = "lang") -> None:
    """Set the limit of rejection and the heat of the score from all labelled texts.

    The limit lies over the entropies that nearly all texts have, and not far
    below that of guessing letters. A text leaves one lowest entropy and one
    loss for each heat; the two entropies around the rank of the limit and the
    sums of the losses reach the driver.
    """
    known = docs.select(F.col("text").cast("string").alias("text"), F.col(language).cast("string").alias("language"))
    known = known.where(F.col("text").isNotNull() & F.col("language").isNotNull())
    place = {x: k for k, x in enumerate(model.languages)}

    def judged(text: pd.Series, language: pd.Series) -> pd.DataFrame:
        rows = []
        for e, of in zip(model.entropies(text.tolist()), language, strict=True):
            if e is None or of not in place:
                rows.append((None, *[None] * len(HEATS)))
            else:
                rows.append((float(e.min()), *[-float(np.log(np.clip(_shares(e[None, :], h)[0, place[of]], 1e-9, 1))) for h in HEATS]))
        return pd.DataFrame(rows, columns=["e", *[f"h{k}" for k in range(len(HEATS))]], dtype=float)

    kinds = "struct<e double, " + ", ".join(f"h{k} double" for k in range(len(HEATS))) + ">"
    found = known.select(F.pandas_udf(judged, kinds)("text", "language").alias("j")).select("j.*").where("e IS NOT NULL")
    found = materialise(found, "entropies")
    # Sums that decide are decimals, so that they do not depend on the order of rows.
    sums = found.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"h{k}").cast("decimal(24,12)")).alias(f"h{k}") for k in range(len(HEATS))]).first()
    if not sums["n"]:
        return
    model.limit = max(_quantile(found, sums["n"], 1 - REJECTED) * 1.25, -0.9 * model.floor)
    model.heat = HEATS[min(range(len(HEATS)), key=lambda k: sums[f"h{k}"])]


def _quantile(found: DataFrame, n: int, share: float) -> float:
    """The quantile of ``e`` over all ``n`` rows, exact and linear between ranks."""
    rank = (n - 1) * share
    # Approximate quantiles on both sides leave about a thousandth of the rows to be sorted.
    low, high = found.agg(F.percentile_approx("e", [max(share - 0.0005 - 2 / n, 0.0), min(share + 0.0005, 1.0)], 10_000).alias("x")).first()["x"]
    before = found.where(F.col("e") < low).count()
    near = found.where(F.col("e").between(low, high)).orderBy("e").offset(int(rank) - before).limit(2).collect()
    return near[0]["e"] + (near[-1]["e"] - near[0]["e"]) * (rank - int(rank))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` and ``rejected``.

    ``score`` is the share of the best language, calibrated on the labelled
    texts. A null text or one without letters, and every text without a model,
    is ``und`` with score 0. ``rejected`` marks a text whose entropy is beyond
    the limit; its best language stays in ``lang_pred``. Ties go to the first
    language by name. Columns other than the results pass through. The model
    that travels names files; a worker opens them where it needs them.
    """
    made = free_name(docs, "_language")
    passed = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def best(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for e in model.entropies(texts.tolist()) if model is not None else [None] * len(texts):
            if e is None:
                rows.append((UNKNOWN, 0.0, True))
            else:
                k = int(np.argmin(e))
                rows.append((model.languages[k], float(_shares(e[None, :], model.heat)[0, k]), bool(e[k] > model.limit)))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    found = F.pandas_udf(best, "struct<lang_pred string, score double, rejected boolean>")(F.col(f"`{text}`").cast("string"))
    return docs.select(*docs.columns, found.alias(made)).select(*passed, f"{made}.lang_pred", f"{made}.score", f"{made}.rejected")
