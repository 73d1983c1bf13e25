"""Language of documents and of their paragraphs: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (languages x BUCKETS) is trained on a bounded hash sample of
labelled rows, cleaned once by the model's own reading of them, and broadcast; paragraphs are
scored in numpy batches. A paragraph departs from its document's language only where the
evidence for another one is clear, so that foreign names in a sentence do not switch it.

Defined results: null, blank and placeholder texts get no row. Ties go to the first language
in alphabetical order. Labels that say nothing count as missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.html import with_displayed
from vacantia.session import settle

LANGS = ("de", "en", "es", "fr", "nl", "pt")
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: What labels are called besides their two letters.
LABELS = {
    "de": ("deu", "ger", "german", "deutsch"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "pt": ("por", "portuguese", "português", "portugues"),
}
#: Texts that stand for nothing.
NOTHING = ("", "n/a", "na", "none", "null", "nil", "tbd", "tba", "-", "--", "unknown", "?", "...", "…")
#: Characters that count as blank at the ends of a paragraph.
BLANKS = " \t\n\x0b\f\r\u00a0"
#: Log-odds a paragraph needs to depart from the rest of its document.
DEPART = 6.0

_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def label_code(label: Column) -> Column:
    """The two letters a stored label denotes, or null if it says nothing that is known."""
    names = F.create_map(*[F.lit(x) for code, names in LABELS.items() for n in (code, *names) for x in (n, code)])
    return names[F.lower(F.regexp_extract(F.trim(label), r"^(\p{L}+)(?:[-_]\p{L}{2,4})?$", 1))]


def paragraphs(texts: DataFrame, name: str = "text") -> DataFrame:
    """Adds parts: the non-empty texts of column `name` between blank lines or block tags, in order; null for null."""
    shown = with_displayed(texts.withColumn("parts", F.regexp_replace(name, r"\r\n?", "\n")), "parts")
    parts = F.transform(F.split("parts", r"\n[\s\u00a0]*\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return shown.withColumn("parts", F.filter(parts, lambda x: x.rlike(r"[\p{L}\p{N}]")))


def grams(texts: list[str], chars: int = 1 << 18) -> Iterator[tuple[slice, list[tuple[np.ndarray, np.ndarray]]]]:
    """Hashed n-grams of runs of texts: which texts, and per order the bucket of each gram and the text it belongs to, in order.

    Runs hold about `chars` characters; a longer text is a run by itself, and goes in whole.
    """
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= chars):
            size += len(texts[stop]) + 1
            stop += 1
        joined = "\0".join(texts[start:stop]).lower()
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        sep = codes == 0
        owner = np.cumsum(sep)
        low = np.minimum(codes, (1 << 16) - 1)
        codes = np.where(_LETTER[low] | sep, codes, 32).astype(np.uint64)
        # one blank stands for any run of others
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = ~((codes[1:] == 32) & (codes[:-1] == 32))
        codes, owner, sep = codes[keep], owner[keep], sep[keep]
        upto = np.concatenate(([0], np.cumsum(sep)))
        found = []
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(codes) < n:
                break
            m = len(codes) - n + 1
            h = (h[:m] + codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if n in ORDERS:
                ok = (upto[n:] - upto[:m]) == 0
                if n == 1:
                    ok &= codes != 32
                found.append((((h[ok] >> np.uint64(17)) & np.uint64(BUCKETS - 1)).astype(np.int64), owner[:m][ok]))
        yield slice(start, stop), found
        start = stop


def count_grams(texts: list[str], langs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(LANGS) * BUCKETS, dtype=np.int64)
    for run, found in grams(texts):
        for bucket, owner in found:
            out += np.bincount(langs[run][owner] * BUCKETS + bucket, minlength=len(out))
    return out.reshape(len(LANGS), BUCKETS)


def log_probabilities(counts: np.ndarray, smoothing: float = 0.05) -> np.ndarray:
    p = counts + smoothing
    return np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)


def score(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-probabilities, texts x languages, over the orders' mean, and the number of letters.

    matrix has a row a bucket, so that a gram costs one look-up for all languages.
    """
    total, size = np.zeros((len(texts), len(LANGS))), np.zeros(len(texts))
    for run, found in grams(texts):
        for bucket, owner in found:
            if len(owner):
                first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
                total[run.start + owner[first]] += np.add.reduceat(matrix[bucket], first, axis=0, dtype=np.float64)
                size[run] += np.bincount(owner, minlength=run.stop - run.start)
    return total / len(ORDERS), size / len(ORDERS)


def train(labelled: DataFrame, sample_rows: int = 20_000) -> np.ndarray:
    """(id, code, parts) to the matrix, a row a bucket. At most about sample_rows rows are used, chosen by hash of the id.

    Copies of one text are chosen or not each by itself, so that a hot group of copies keeps its
    share and the bound holds.
    """
    spark = labelled.sparkSession
    labelled = labelled.filter("code is not null and size(parts) > 0")
    total = labelled.count()
    share = min(1.0, sample_rows / max(total, 1))
    part = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else labelled
    part = part.select(F.array_position(F.array(*map(F.lit, LANGS)), F.col("code")).cast("int").alias("k"), F.array_join("parts", " ").alias("text"))
    part = settle(part.coalesce(8), "language-sample")

    def counted(matrix):
        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(LANGS), BUCKETS), dtype=np.int64)
            for pdf in batches:
                texts, langs = pdf["text"].tolist(), pdf["k"].to_numpy() - 1
                if matrix is not None:  # only rows whose label the first model confirms
                    ok = score(texts, matrix.value)[0].argmax(axis=1) == langs
                    texts, langs = [t for t, y in zip(texts, ok) if y], langs[ok]
                if texts:
                    out += count_grams(texts, langs)
            yield pd.DataFrame({"m": [out.astype(np.int32).tobytes()]})

        return one

    matrix = None
    for _ in range(2):
        # at most eight rows of 1.5 MB reach the driver
        rows = part.mapInPandas(counted(matrix), "m binary").collect()
        counts = sum((np.frombuffer(r["m"], dtype=np.int32).reshape(len(LANGS), BUCKETS).astype(np.int64) for r in rows), np.zeros((len(LANGS), BUCKETS), dtype=np.int64))
        matrix = spark.sparkContext.broadcast(np.ascontiguousarray(log_probabilities(counts).T))
    return matrix.value


def identify(texts: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(id, parts) to one row a text: its language with a confidence, and arrays of the same per paragraph. Other columns are kept out."""
    shared = texts.sparkSession.sparkContext.broadcast(matrix)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat, owner = [], []
            for i, parts in enumerate(pdf["parts"]):
                if len(parts) != 1 or parts[0].lower() not in NOTHING:
                    flat.extend(parts)
                    owner.extend([i] * len(parts))
            if not flat:
                continue
            owner = np.array(owner)
            logs, letters = score(flat, shared.value)
            whole = np.zeros((len(pdf), len(LANGS)))
            np.add.at(whole, owner, logs)
            home = whole.argmax(axis=1)[owner]
            best = logs.argmax(axis=1)
            at = np.arange(len(flat))
            best = np.where(logs[at, best] - logs[at, home] >= DEPART, best, home)
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            sure = odds[at, best] / odds.sum(axis=1)
            mass = np.zeros((len(pdf), len(LANGS)))
            np.add.at(mass, (owner, best), np.maximum(letters, 1e-9))
            most = mass.argmax(axis=1)
            ends = np.searchsorted(owner, np.arange(len(pdf) + 1))
            rows = [i for i in range(len(pdf)) if ends[i + 1] > ends[i]]
            yield pd.DataFrame(
                {
                    "id": pdf["id"].to_numpy()[rows],
                    "lang": [LANGS[most[i]] for i in rows],
                    "confidence": [float(mass[i, most[i]] / mass[i].sum() * np.average(sure[ends[i] : ends[i + 1]])) for i in rows],
                    "langs": [[LANGS[k] for k in best[ends[i] : ends[i + 1]]] for i in rows],
                    "sure": [sure[ends[i] : ends[i + 1]].tolist() for i in rows],
                }
            )

    return texts.filter("size(parts) > 0").select("id", "parts").mapInPandas(read, "id long, lang string, confidence double, langs array<string>, sure array<double>")
