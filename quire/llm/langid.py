"""Language identification: text likelihoods fused with markup language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

#: Distinct labelled texts of each language that the text model is fitted on: a documented, bounded sample.
SAMPLE = 2000
#: Bins of hashed byte trigrams; trigrams of a very long text that are scored at once.
BINS, SLICE = 1 << 16, 1 << 20
#: Weight of one level's parent against its own counts, and of a suffix's own language before anything is counted.
PARENT, SUFFIX = 20.0, 5.0
#: Trigrams overlap and repeat, so each counts as a fraction of an independent observation.
EVIDENCE = 0.2
#: Nats a trigram below the fitted languages' own mean where "other" becomes the likelier.
OTHER_MARGIN = 3.0
OTHER_PRIOR = 1e-3
#: Below this posterior a document's language counts as not identified.
LEAST_POSTERIOR = 0.5
#: Country suffixes that speak for one language. Fixed values.
SUFFIX_LANGUAGE = {"at": "de", "de": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "uk": "en", "us": "en", "au": "en", "ie": "en"}

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Bins of the byte trigrams of the lower-cased words, slice by slice; the words of the whole text."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    if not words:
        return
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    for at in range(0, len(a) - 2, SLICE):
        s = a[at : at + SLICE + 2].astype(np.uint32)
        yield (((s[:-2] << 16) | (s[1:-1] << 8) | s[2:]) * np.uint32(2654435761)) >> np.uint32(16)


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities (bins x languages) and the mean log-likelihood a trigram of each language's own text."""

    langs: tuple[str, ...]
    table: np.ndarray
    own: np.ndarray

    def likelihoods(self, text: str | None) -> tuple[np.ndarray, int]:
        """Summed log-likelihoods of the languages and of "other" (last), and the number of trigrams."""
        total, n = np.zeros(len(self.langs)), 0
        for h in trigrams(text):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return np.append(total, n * (self.own.min() - OTHER_MARGIN)), n


def fit(docs: DataFrame, sample: int = SAMPLE, lang_col: str = "lang") -> TextModel:
    """The text model from at most ``sample`` distinct texts of each label, those with the smallest hashes.

    Copies of a text count once, so neither they nor a frequent language keep another one out. Tasks hand on their
    own smallest hashes; texts move for the chosen ones only.
    """
    rows = docs.where(f"`{lang_col}` is not null and `{lang_col}` <> '' and text is not null").select("text", F.col(lang_col).alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("text"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs, h = np.array(b.column("lang").to_pylist(), object), b.column("h").to_numpy()
            for lang in set(langs):
                held[lang] = np.union1d(held.get(lang, h[:0]), h[langs == lang])[:sample]
        for lang, h in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h, pa.int64())], ["lang", "h"])

    hashes = rows.select("lang", "h").mapInArrow(least, "lang string, h long").distinct()
    chosen = keep(hashes.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample).select("lang", "h"), "sample")
    some = rows.join(chosen, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(BINS, np.int64))
                for h in trigrams(text.as_py()):
                    own += np.bincount(h, minlength=BINS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bin", "n"])

    counted = some.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = tuple(sorted(set(counted.column("lang").to_pylist())))
    if not langs:
        return TextModel(("und",), np.full((BINS, 1), -np.log(BINS), np.float32), np.full(1, -np.log(BINS)))
    c = np.zeros((BINS, len(langs)))
    c[counted.column("bin").to_numpy(), [langs.index(x) for x in counted.column("lang").to_pylist()]] = counted.column("n").to_numpy()
    p = (c + 0.05) / (c + 0.05).sum(axis=0)
    return TextModel(langs, np.log(p).astype(np.float32), (c * np.log(p)).sum(axis=0) / np.maximum(1, c.sum(axis=0)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _evidence(docs: DataFrame, host: Column | None, declared: Column | None) -> DataFrame:
    """text, its host with the two suffixes above it, and the declared language's primary subtag."""
    h = F.lower(host) if host is not None else F.lit(None).cast("string")
    parts = F.split(h, r"\.")
    many = F.size(parts) > 1
    tag = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})\b", 1)) if declared is not None else F.lit("")
    return docs.withColumns({
        "__host": h,
        "__domain": F.when(F.size(parts) > 2, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))),
        "__suffix": F.when(many & (h != ""), F.try_element_at(parts, F.lit(-1))),
        "__declared": F.coalesce(tag, F.lit("")),
    })


_KEYS = ["__host", "__domain", "__suffix", "__declared"]


def _counted(evidence: DataFrame, model: TextModel) -> DataFrame:
    """(keys, label, n): how many texts of each host and declaration the text model alone is sure of."""

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = []
            for text in b.column("text"):
                ll, n = model.likelihoods(text.as_py())
                p = _softmax(EVIDENCE * ll)
                best = int(p.argmax())
                labels.append(best if n and best < len(model.langs) and p[best] > 0.9 else None)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in _KEYS), pa.array(labels, pa.int32())], [*_KEYS, "label"])

    schema = ", ".join(f"{k} string" for k in _KEYS) + ", label int"
    return evidence.select("text", *_KEYS).mapInArrow(sure, schema).where("label is not null").groupBy(*_KEYS, "label").count()


def _priors(counts: DataFrame, langs: tuple[str, ...]) -> tuple[DataFrame, np.ndarray]:
    """(__host, __prior) by hierarchical smoothing: host over domain over suffix over all; and the prior of all."""
    k = range(len(langs))
    sums = [F.sum(F.when(F.col("label") == i, F.col("count")).otherwise(0)).cast("double").alias(f"n{i}") for i in k]
    top = counts.agg(*sums).first()
    n = np.array([top[i] or 0.0 for i in k]) + 1.0
    overall = n / n.sum()
    of_suffix = {s: langs.index(x) for s, x in SUFFIX_LANGUAGE.items() if x in langs}

    def smoothed(own: list[Column], parent: list[Column]) -> list[Column]:
        total = sum(own[1:], own[0])
        return [(c + PARENT * p) / (total + PARENT) for c, p in zip(own, parent, strict=True)]

    hosts = counts.where("__host is not null").groupBy("__host", "__domain", "__suffix").agg(*sums)
    table = hosts
    for key in ("__domain", "__suffix"):
        level = hosts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_of")).agg(*[F.sum(f"n{i}").alias(f"{key}{i}") for i in k])
        table = table.join(level, F.col(key) == F.col(f"{key}_of"), "left")
    own_suffix = [F.when(F.col("__suffix").isin([s for s, x in of_suffix.items() if x == i] or [""]), SUFFIX).otherwise(0.0) for i in k]
    suffix = smoothed([F.coalesce(F.col(f"__suffix{i}"), F.lit(0.0)) + own_suffix[i] for i in k], [F.lit(float(x)) for x in overall])
    table = table.select("__host", *[f"n{i}" for i in k], *[F.coalesce(f"__domain{i}", F.lit(0.0)).alias(f"d{i}") for i in k], *[c.alias(f"s{i}") for i, c in enumerate(suffix)])
    domain = smoothed([F.col(f"d{i}") for i in k], [F.col(f"s{i}") for i in k])
    table = table.select("__host", *[f"n{i}" for i in k], *[c.alias(f"d{i}") for i, c in enumerate(domain)])
    host = smoothed([F.col(f"n{i}") for i in k], [F.col(f"d{i}") for i in k])
    return table.select(F.col("__host").alias("__of"), F.array(*host).alias("__prior")), overall


def _declared(counts: DataFrame, langs: tuple[str, ...]) -> dict[str, np.ndarray]:
    """log P(declared | language) for the model's languages, any other declaration ("*") and none ("")."""
    kinds = [*langs, "*", ""]
    kind = F.when(F.col("__declared").isin([*langs, ""]), F.col("__declared")).otherwise("*")
    n = np.ones((len(kinds), len(langs)))
    for r in counts.groupBy(kind.alias("d"), "label").agg(F.sum("count").alias("n")).collect():  # as many rows as kinds x languages
        n[kinds.index(r["d"]), r["label"]] += r["n"]
    return dict(zip(kinds, np.log(n / n.sum(axis=0)), strict=True))


def _judged(evidence: DataFrame, model: TextModel, outputs, schema) -> DataFrame:
    """Joins the priors and calls ``outputs(batch, posteriors, trigram counts)`` for each batch."""
    counts = keep(_counted(evidence, model), "languages")
    priors, overall = _priors(counts, model.langs)
    says = _declared(counts, model.langs)
    joined = evidence.join(priors, evidence["__host"] == priors["__of"], "left").drop("__of")
    other = np.append(np.full(len(model.langs), np.log1p(-OTHER_PRIOR)), np.log(OTHER_PRIOR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            post, counts_ = [], []
            for text, prior, tag in zip(b.column("text"), b.column("__prior").to_pylist(), b.column("__declared").to_pylist(), strict=True):
                ll, n = model.likelihoods(text.as_py())
                p = np.append(np.log(prior or overall), 0.0)
                d = says.get(tag, says["*"])
                post.append(_softmax(EVIDENCE * ll + p + np.append(d, d.mean()) + other))
                counts_.append(n)
            yield outputs(b, np.array(post).reshape(len(post), len(model.langs) + 1), np.array(counts_, np.int64))

    return joined.mapInArrow(run, schema)


def _accepted(post: np.ndarray, n: np.ndarray) -> np.ndarray:
    best = post.argmax(axis=1)
    return (n > 0) & (best < post.shape[1] - 1) & (post[np.arange(len(post)), best] >= LEAST_POSTERIOR)


def identify(docs: DataFrame, id_col: str = "doc_id", host: Column | None = None, declared: Column | None = None, model: TextModel | None = None) -> DataFrame:
    """id, language, posterior, n_trigrams, accepted for each row of ``docs`` (id, text, and lang if no model is given).

    Two passes over whole texts: the first counts, by host and declared language, what the text model is sure of;
    the second fuses a text's likelihoods with P(declared | language) and the host's prior, which is smoothed with
    its domain's, suffix's and the whole table's. language is null and accepted false where there is no letter, no
    posterior of ``LEAST_POSTERIOR``, or "other" is the likeliest. Null hosts, texts and declarations are missing
    evidence; repeated rows each have a row; an empty table gives no rows. Priors join by host: Spark broadcasts them
    only where their measured size is below its threshold.
    """
    model = model or fit(docs)
    evidence = _evidence(docs.select(F.col(id_col).cast("long").alias(id_col), "text", (host if host is not None else F.lit(None).cast("string")).alias("__h"), (declared if declared is not None else F.lit(None).cast("string")).alias("__d")), F.col("__h"), F.col("__d")).drop("__h", "__d")

    def outputs(b: pa.RecordBatch, post: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ok = _accepted(post, n)
        best = post.argmax(axis=1) if len(post) else np.zeros(0, int)
        langs = [model.langs[i] if k else None for i, k in zip(best, ok, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(id_col), pa.array(langs, pa.string()), pa.array(post.max(axis=1) if len(post) else []), pa.array(n), pa.array(ok)], [id_col, "language", "posterior", "n_trigrams", "accepted"])

    return _judged(evidence, model, outputs, f"{id_col} long, language string, posterior double, n_trigrams long, accepted boolean")


def accepted(docs: DataFrame, host: Column | None = None, declared: Column | None = None, model: TextModel | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose language is identified; see :func:`identify`."""
    model = model or fit(docs)
    names = docs.columns
    evidence = _evidence(docs, host, declared)

    def outputs(b: pa.RecordBatch, post: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return b.select(names).filter(pa.array(_accepted(post, n)))

    return _judged(evidence, model, outputs, docs.schema)
