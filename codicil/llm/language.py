"""Language identification by compression.

Each language gets a zstandard raw-content dictionary of its texts. A text is compressed
whole with each of them; the language whose dictionary gives the fewest bytes wins. Texts
are lower-cased first, and runs of what is no letter become one space.

Rules: null texts and texts without a letter are ``und`` with score 0. Ties go to the language
that sorts first. Where nothing could be learned (no labelled text) every text is ``und``.
Null languages are not learned from. ``rejected`` marks narrow margins; the prediction stays.

Learning is bounded: the LANGUAGES with the most labelled texts (ties: the first by name), at most SAMPLE texts a language, the first by a hash of their id, of at most
LONGEST characters each, and DICT_BYTES bytes a dictionary; texts that repeat few words are passed over.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, crc_of_id, pick, texts_of

SAMPLE, LONGEST, DICT_BYTES, LEVEL, MARGIN, LANGUAGES = 400, 20_000, 262_144, 9, 0.02, 200
#: Least share of distinct words in a text to learn from.
DISTINCT = 0.4
LETTER, NO_LETTERS = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    return NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def learn(docs: DataFrame, sample: int = SAMPLE, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary for each language of ``docs`` (doc_id, text, lang). LANGUAGES bounds how many there may be.

    ``sample`` documents of each by hash are learned from; of a longer text LONGEST code points."""
    rows = pick(docs, doc_id="long", text="string", lang="string").where("lang is not null and text is not null and doc_id is not null")
    langs = sorted(r.lang for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    rows = rows.where(F.col("lang").isin(langs)).withColumns({"h": F.xxhash64("doc_id", F.lit(5)), "th": F.xxhash64("text")})
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "th"))
    chosen = rows.select("lang", "doc_id", "h", "th").withColumn("nth", nth).where(F.col("nth") <= sample).select("lang", "doc_id", "th").distinct()  # sample * LANGUAGES rows at most
    texts: dict[str, list[tuple[int, str]]] = {}
    if langs:
        own = rows.join(F.broadcast(chosen), ["lang", "doc_id", "th"]).select("lang", "doc_id", "th", "h", F.substring("text", 1, LONGEST).alias("text"))
        for r in own.dropDuplicates(["lang", "doc_id", "th"]).collect():
            texts.setdefault(r.lang, []).append((r.h, r.text))
    out = {}
    for lang in langs:
        parts, size = [], 0
        for _, text in sorted(texts.get(lang, [])):
            raw, words = plain(text), text.split()
            if len(set(words)) < DISTINCT * len(words) and parts:
                continue
            if size + len(raw) + 1 <= dict_bytes or not parts:
                parts.append(raw)
                size += len(raw) + 1
        if parts:
            out[lang] = b" ".join(parts)[:dict_bytes]
    return {k: v for k, v in out.items() if len(v) >= 8}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = plain(text)
        return [len(c.compress(raw)) for c in self.coders]

    def __call__(self, text: str) -> tuple[str, float, float]:
        """language, score, margin (bytes saved against the second best, as a share)."""
        if not self.langs or not LETTER.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] * 2)
        score = 1 / sum(math.exp(-min(50.0, (s - sizes[best]) / 4)) for s in sizes)
        return self.langs[best], score, 1 - sizes[best] / max(1, second)


_kept: dict = {}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if _kept.get("of") is not shared.value:
            _kept.update(of=shared.value, by=Classifier(shared.value))
        found = [_kept["by"](t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([x for x, _, _ in found], pa.string()),
                pa.array([x for _, x, _ in found], pa.float64()),
                pa.array([x for _, _, x in found], pa.float64()),
                pa.array([x != "und" and m < margin for x, _, m in found], pa.bool_()),
            ],
            ["doc_id", "lang_pred", "score", "margin", "rejected"],
        )

    return arrow_map(pick(docs, doc_id="long", text="string"), run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def predict_held_out(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the rows whose crc32 of the id as text is not 0 modulo ``folds`` and classifies all rows."""
    held = F.coalesce(crc_of_id(F.col("doc_id").cast("long")) % folds == 0, F.lit(False))
    out = classify(docs, learn(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")
