"""Language identification by fusing evidence: text, declared markup language, address suffix, host.

The text's likelihood under each language's byte trigrams is combined by Bayes' rule with how often
a declared language or an address suffix is right, and with a prior of the host.  The hosts' priors
are sums of the texts' posteriors, smoothed towards their suffix's, and that towards the whole corpus's.
One more hypothesis, no language at all, has evenly spread trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, narrow, packed, staged, summed, tidied, utf8
from .text import LOWER

SLOTS = 1 << 16
#: Labelled rows of each language that a model is fitted on, about: those with small hashes of id and text.
SAMPLE_ROWS = 4000
#: A text counts as this many independent trigrams at most.
TEXT_WEIGHT = 200.0
#: How often a declared language and an address suffix are right.
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.8
#: Pseudo-documents of the prior one level up.
STRENGTH = 20.0
NO_LANGUAGE = 1e-3
LEAST_POSTERIOR = 0.5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Log probabilities (languages + 1, SLOTS); the last row is that of no language.
    table: np.ndarray


def _slots(buf: np.ndarray) -> np.ndarray:
    """The slot of the trigram that starts at each byte; letters A-Z are lowered."""
    b = LOWER[buf].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trigram tables of every labelled language, whole texts, counted on the executors.

    A language of at most `sample_rows` labelled rows gives all of them; of a larger one each row is taken with a chance of
    `sample_rows` to its rows, by the hash of id and text, so that about `sample_rows` are.  Rows equal in id and text count once.
    """
    rows = docs.select(F.lower(docs[lang_col].cast("string")).alias("lang"), docs[text_col].cast("string").alias("text"), docs[id_col].cast("long").alias("doc_id")).where("lang is not null and lang <> '' and text is not null")
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    # One row per language: the hashes, as 53 bits, that are taken lie below its limit.
    limits = docs.sparkSession.createDataFrame([(x, min(2**53, 2**53 * sample_rows // n)) for x, n in sizes.items()], "lang string, below long")
    taken = rows.join(F.broadcast(limits), "lang").where(F.shiftrightunsigned("h", 11) < F.col("below"))
    sample = staged(taken.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text"), "language-sample")
    size = max(1, len(languages)) * SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                if len(text) > 2:
                    at = languages.index(lang) * SLOTS
                    total[at : at + SLOTS] += np.bincount(_slots(np.frombuffer(text, dtype=np.uint8)), minlength=SLOTS)
        yield packed(total)

    counts = summed(sample.mapInArrow(tidied(count), "counts binary"), size).reshape(-1, SLOTS).astype(np.float64)[: len(languages)]
    shares = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
    return Model(languages, np.log(np.vstack([shares, np.full((1, SLOTS), 1 / SLOTS)])).astype(np.float32))


def text_scores(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods (texts, languages + 1), weighted as TEXT_WEIGHT trigrams at most, and the numbers of trigrams."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = np.maximum(sizes - 2, 0)
    out = np.zeros((len(texts), len(model.languages) + 1))
    if n.sum():
        buf = np.frombuffer(b"".join(texts) + b"  ", dtype=np.uint8)
        slots = _slots(buf)
        starts = np.cumsum(sizes) - sizes
        full = np.flatnonzero(n)
        # The two trigrams across each text's end lie between one text's last and the next one's first.
        cuts = np.stack([starts[full], starts[full] + n[full]], axis=1).ravel()
        for k, row in enumerate(model.table):
            sums = np.add.reduceat(np.append(row[slots], np.float32(0)), cuts, dtype=np.float64)[::2]
            out[full, k] = sums * np.minimum(1, TEXT_WEIGHT / n[full])
    return out, n


def _evidence(column: Column, languages: tuple[str, ...], right: float) -> Column:
    """Log likelihoods of a declared language; unknown or absent ones say nothing."""
    wrong = (1 - right) / max(1, len(languages) - 1)
    known = column.isin(*languages)
    return F.array(*[F.when(known, F.when(column == lang, float(np.log(right))).otherwise(float(np.log(wrong)))).otherwise(0.0) for lang in languages])


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _shares(scores: Column) -> Column:
    """Log scores as shares of one."""
    top = F.array_max(scores)
    raw = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda s, y: s + y))


def identify(docs: DataFrame, model: Model, host_col: str | None = "source", id_col: str = "doc_id", text_col: str = "text", markup_col: str | None = None, address_col: str | None = None, kind_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, th (hash of the text), language, posterior, accepted, and kind, the string in `kind_col`, where one is named.

    `markup_col` holds markup (its declared language is the first lang attribute), by default the text itself;
    `address_col` an address (its suffix may name a language), by default the host.  A document is accepted if its best
    language beats all others and no language together (posterior of at least LEAST_POSTERIOR).  Texts without
    three bytes in a row (null, empty) have no language and are rejected, and so is everything if no row was labelled.
    A null host is one host of its own.  Rows with null or repeated ids are judged each for itself; an empty
    table gives an empty result.
    """
    langs = model.languages
    schema = "doc_id long, th long, kind string, host string, suffix string, declared string, n long, scores array<double>"
    own = ("doc_id", "th", "kind") if kind_col else ("doc_id", "th")
    base = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        (F.coalesce(docs[host_col].cast("string"), F.lit("")) if host_col else F.lit("")).alias("host"),
        F.lower(F.regexp_extract(F.coalesce((docs[address_col] if address_col else docs[host_col] if host_col else F.lit("")).cast("string"), F.lit("")), r"^(?:[a-zA-Z]+://)?[^/?#]*\.([a-zA-Z]{2,})(?::\d+)?(?:[/?#]|$)", 1)).alias("suffix"),
        (F.coalesce(docs[markup_col].cast("string"), F.lit("")) if markup_col else F.lit(None).cast("string")).alias("markup"),
        (docs[kind_col].cast("string") if kind_col else F.lit(None).cast("string")).alias("kind"),
    )
    base = base.withColumn("markup", F.coalesce("markup", "text"))
    declared = F.when(F.contains("markup", F.lit("lang=")), F.lower(F.regexp_extract("markup", r"""<[^<>]*\blang=["']?([a-zA-Z]{2,3})\b""", 1))).otherwise("")
    base = base.select("doc_id", F.xxhash64("text").alias("th"), "kind", "host", "suffix", declared.alias("declared"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1_000_000):
            scores, n = text_scores(model, utf8(batch.column("text")))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "th", "kind", "host", "suffix", "declared")), pa.array(n), values], names=["doc_id", "th", "kind", "host", "suffix", "declared", "n", "scores"])

    scored = staged(base.mapInArrow(tidied(score), schema), "language-scores")
    if not langs:
        return scored.select(*own, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    # No language is as likely under any declaration as a random one.
    none = F.array(F.lit(0.0))
    extra = _added(F.concat(_evidence(F.col("declared"), langs, DECLARED_RIGHT), none), F.concat(_evidence(F.col("suffix"), langs, SUFFIX_RIGHT), none))
    rows = scored.withColumn("scores", _added("scores", extra))
    flat = F.array(*[F.lit(float(np.log((1 - NO_LANGUAGE) / len(langs))))] * len(langs), F.lit(float(np.log(NO_LANGUAGE))))
    soft = rows.where("n > 0").select("host", "suffix", _shares(_added("scores", flat)).alias("p"))
    sums = [F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(len(langs))]
    hosts = staged(soft.groupBy("host", "suffix").agg(*sums), "host-counts")
    again = [F.sum(f"c{i}").alias(f"s{i}") for i in range(len(langs))]
    suffixes = hosts.groupBy("suffix").agg(*again)
    whole = [float(x or 0) for x in hosts.agg(*again).first()]
    overall = [(x + 1) / (sum(whole) + len(langs)) for x in whole]
    total = lambda c: sum((F.col(f"{c}{i}") for i in range(1, len(langs))), F.col(f"{c}0"))
    smooth = suffixes.select("suffix", *[((F.col(f"s{i}") + STRENGTH * overall[i]) / (total("s") + STRENGTH)).alias(f"q{i}") for i in range(len(langs))])
    prior = hosts.join(smooth, "suffix").select("host", "suffix", F.array(*[F.log((1 - NO_LANGUAGE) * (F.col(f"c{i}") + STRENGTH * F.col(f"q{i}")) / (total("c") + STRENGTH)) for i in range(len(langs))], F.lit(float(np.log(NO_LANGUAGE)))).alias("prior"))
    fused = rows.join(staged(prior, "host-priors"), ["host", "suffix"], "left").withColumn("p", _shares(_added("scores", F.coalesce("prior", flat))))
    best = F.array_max("p")
    at = F.array_position("p", best).cast("int")
    names = F.array(*[F.lit(x) for x in langs], F.lit(None).cast("string"))
    return fused.select(
        *own,
        F.when(F.col("n") > 0, F.element_at(names, at)).alias("language"),
        F.when(F.col("n") > 0, F.round(best, 6)).otherwise(0.0).alias("posterior"),
        ((F.col("n") > 0) & (at <= len(langs)) & (best >= LEAST_POSTERIOR)).alias("accepted"),
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is identified, all columns kept; the model is fitted on their own labels."""
    found = identify(docs, fit(docs))
    gone = staged(found.where("not accepted").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "rejected")
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (text == gone["_th"]), "left_anti")


def page_text(html: Column) -> Column:
    """What stands between a page's tags, without the content of scripts and styles up to their next tag; in time linear in the page."""
    return F.regexp_replace(html.cast("string"), r"(?i)<(?:script|style)\b[^<>]*>[^<]*|<[^<>]*>", " ")


def documents_and_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, id, text, markup, host, address of all rows of both tables: a document's source is its host and address, its text its markup."""
    host = F.lower(F.regexp_extract(pages["url"].cast("string"), r"^(?:[a-zA-Z]+://)?([^/?#:]+)", 1))
    source = docs["source"].cast("string")
    text = docs["text"].cast("string")
    own = docs.select(F.lit("document").alias("kind"), docs["doc_id"].cast("long").alias("id"), text.alias("text"), text.alias("markup"), source.alias("host"), source.alias("address"))
    return own.unionByName(pages.select(F.lit("page").alias("kind"), pages["page_id"].cast("long").alias("id"), page_text(pages["html"]).alias("text"), pages["html"].cast("string").alias("markup"), host.alias("host"), pages["url"].cast("string").alias("address")))


def language_table(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, language, posterior, accepted of `docs`, by a model of their own labels; with `pages`, page_id too and a row for each page.

    A document's row has a null page_id, a page's a null doc_id.  A page's declared language and address are evidence beside
    what stands between its tags, and its host's prior is smoothed towards its suffix's.  Null pages, or pages of tags
    alone, have no language; a null address is one host of its own.
    """
    narrow(docs)  # fails early where columns are missing
    if pages is None:
        return identify(docs, fit(docs)).drop("th")
    found = identify(documents_and_pages(docs, pages), fit(docs), "host", "id", "text", "markup", "address", "kind")
    each = lambda kind: F.when(F.col("kind") == kind, F.col("doc_id"))
    return found.select(each("document").alias("doc_id"), each("page").alias("page_id"), "language", "posterior", "accepted")
