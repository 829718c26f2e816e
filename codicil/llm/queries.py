"""The registered queries of the subpackage: thin layers over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_templates import drop_lines

    return drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import predict_held_out

    return predict_held_out(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    return quality(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_held_out

    found = score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "nearest")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), least=10, within=50, top=2000)


def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=85)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import audited

    return audited(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_line_templates, op2_personal_data, op3_suffix_dedup, op4_jaccard, op5_language, op6_quality, op7_toxicity, op8_byte_bpe, op9_decontaminate, op10_page_text,
        op11_collocations, op12_chosen_path, op13_merkle,
    )
    return {f.__name__: f for f in found}


#: Words of a text, as the contract has them, for DuckDB.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: Lower-cases A-Z alone.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _jaccard_sql(k: int, percent: int, more: str = "") -> str:
    """The groups of the Jaccard join on shingles of k words."""
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
  spread AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0),
  sets AS (SELECT doc_id, list_sort(list_distinct(list(array_to_string(w[i : i + {k - 1}], ' ')))) AS s FROM spread GROUP BY doc_id),
  classes AS (SELECT s, min(doc_id) AS rep FROM sets GROUP BY s),
  grams AS (SELECT rep, unnest(s) AS g FROM classes),
  pairs AS (SELECT x.rep AS a, y.rep AS b, count(*) AS n_both FROM grams x JOIN grams y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE 100 * n_both >= {percent} * (len(x.s) + len(y.s) - n_both)),
  edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT rep, rep AS root FROM classes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.rep),
  least AS (SELECT rep, min(root) AS root FROM reach GROUP BY rep)
SELECT d.doc_id, coalesce(len(sets.s), 0)::BIGINT AS n_shingles, coalesce(least.root, d.doc_id) AS component_id{more}
FROM documents d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN classes ON classes.s = sets.s LEFT JOIN least ON least.rep = classes.rep"""


JACCARD_SQL = _jaccard_sql(3, 90)
CHOSEN_PATH_SQL = _jaccard_sql(5, 85, ", d.doc_id IS NOT DISTINCT FROM coalesce(least.root, d.doc_id) AS kept")

QUALITY_SQL = rf"""WITH docs AS (SELECT doc_id, coalesce(source, chr(0)) AS host, text IS NOT NULL AS there, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
  windows AS (SELECT doc_id, array_to_string(w[i : i + 7], ' ') AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
  twice AS (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
  repeated AS (SELECT doc_id, count(DISTINCT place) AS n FROM twice GROUP BY doc_id),
  counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM docs),
  lines AS (SELECT doc_id, host, unnest(list_transform(string_split(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x))) AS line FROM docs WHERE there),
  held AS (SELECT host, line, count(DISTINCT doc_id) AS n FROM lines WHERE line <> '' GROUP BY ALL),
  hosts AS (SELECT host, count(*) AS n FROM docs GROUP BY host),
  above AS (SELECT held.host, line FROM held JOIN hosts ON hosts.host = held.host WHERE held.n > greatest(20, 0.10 * hosts.n)),
  removed AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) AS n FROM lines l JOIN above a ON a.host = l.host AND a.line = l.line GROUP BY doc_id),
  every AS (SELECT c.doc_id, n_words, word_chars, n_symbols, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS n_removed_words
    FROM counts c LEFT JOIN repeated r ON r.doc_id = c.doc_id LEFT JOIN removed g ON g.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 0.30 * n_words AS kept, n_removed_words FROM every"""

_LEAK_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS_SQL = f"""WITH docs AS (SELECT doc_id, {_LEAK_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
  items AS (SELECT item_id, {_LEAK_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark WHERE item_id IS NOT NULL),
  spread AS (SELECT item_id, least(len(w), 10) AS size, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
  windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS x FROM spread),
  sizes AS (SELECT DISTINCT size FROM windows),
  places AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size),
  hits AS (SELECT p.doc_id, p.i, p.size, v.item_id FROM (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS x FROM places) p JOIN windows v ON v.size = p.size AND v.x = p.x),
  covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
  found AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""


_WORD = r"regexp_extract_all({}, '[^\x20\x09]+')"
COLLOCATIONS_SQL = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  words AS (SELECT lang, {_WORD.format("piece")} AS w FROM pieces),
  places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
  one AS (SELECT lang, w[i] AS phrase, count(*) AS f FROM places GROUP BY ALL),
  two AS (SELECT lang, w[i] || ' ' || w[i + 1] AS phrase, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM places WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
  three AS (SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM places WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
  total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
  longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, x || ' ' || y AS phrase, f FROM three UNION ALL SELECT lang, y || ' ' || z, f FROM three) GROUP BY ALL),
  cuts AS (SELECT t.lang, t.phrase, t.f AS a, 1 AS k, l.f AS l, r.f AS r FROM two t JOIN one l ON l.lang = t.lang AND l.phrase = t.x JOIN one r ON r.lang = t.lang AND r.phrase = t.y
      LEFT JOIN longer g ON g.lang = t.lang AND g.phrase = t.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * t.f
    UNION ALL SELECT t.lang, t.phrase, t.f, 1, l.f, r.f FROM three t JOIN one l ON l.lang = t.lang AND l.phrase = t.x JOIN two r ON r.lang = t.lang AND r.phrase = t.y || ' ' || t.z
    UNION ALL SELECT t.lang, t.phrase, t.f, 2, l.f, r.f FROM three t JOIN two l ON l.lang = t.lang AND l.phrase = t.x || ' ' || t.y JOIN one r ON r.lang = t.lang AND r.phrase = t.z),
  scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
  least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
#: crc32 by its table of 256 remainders, as DuckDB has no such function.
_CRC = """poly(i, k, c) AS (SELECT range, 0, range::UINTEGER FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UINTEGER) ELSE c // 2 END FROM poly WHERE k < 8),
  remainders AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
  crcs AS (SELECT doc_id AS id, xor(4294967295::UINTEGER, list_reduce(list_prepend(4294967295::UINTEGER, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UINTEGER)),
    lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), remainders)"""
MERKLE_SQL = f"""WITH RECURSIVE {_CRC},
  leaves AS (SELECT d.doc_id, coalesce('1' || lang, '0') AS g, {_LEAF.format(n="n_chars")} AS leaf,
    CASE WHEN crc % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS other FROM documents d LEFT JOIN crcs ON crcs.id = d.doc_id),
  placed AS (SELECT *, row_number() OVER (ORDER BY g, doc_id, leaf) AS nr, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS total FROM leaves),
  up(g, lvl, place, h, total) AS (SELECT g, 0, place, leaf, total FROM placed UNION ALL SELECT g, lvl + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 1) // 2 FROM up WHERE total > 1 GROUP BY g, lvl, place // 2),
  subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS total FROM up WHERE total = 1),
  top(lvl, place, h, total) AS (SELECT 0, place, h, total FROM subroots UNION ALL SELECT lvl + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(total) + 1) // 2 FROM top WHERE total > 1 GROUP BY lvl, place // 2),
  steps AS (SELECT g, lvl, place, h, total FROM up WHERE total > 1 UNION ALL SELECT s.g, 1000 + t.lvl, t.place, t.h, t.total FROM subroots s JOIN top t ON t.total > 1),
  beside AS (SELECT p.nr, s.lvl, s.place % 2 AS side, s.h FROM placed p JOIN subroots r ON r.g = p.g JOIN steps s ON s.g = p.g AND s.place = xor(CASE WHEN s.lvl < 1000 THEN p.place >> s.lvl ELSE r.place >> (s.lvl - 1000) END, 1)),
  heights AS (SELECT g, list(lvl ORDER BY lvl) AS lvls FROM (SELECT DISTINCT g, lvl FROM steps) GROUP BY g),
  proofs AS (SELECT nr, string_agg(h, '' ORDER BY lvl) AS proof, map(list(lvl), list(struct_pack(side := side, h := h))) AS at FROM beside GROUP BY nr),
  folding(nr, k, h) AS (SELECT nr, 1, other FROM placed UNION ALL SELECT f.nr, f.k + 1, sha256(CASE WHEN q.at[hs.lvls[f.k]] IS NULL THEN f.h WHEN q.at[hs.lvls[f.k]].side = 0 THEN q.at[hs.lvls[f.k]].h || f.h ELSE f.h || q.at[hs.lvls[f.k]].h END)
    FROM folding f JOIN placed p ON p.nr = f.nr JOIN heights hs ON hs.g = p.g LEFT JOIN proofs q ON q.nr = f.nr WHERE f.k <= len(hs.lvls)),
  ends AS (SELECT nr, arg_max(h, k) AS h FROM folding GROUP BY nr)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM placed p JOIN subroots s ON s.g = p.g JOIN top t ON t.total = 1 JOIN ends e ON e.nr = p.nr LEFT JOIN proofs q ON q.nr = p.nr"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are held against plain versions in the tests."""
    return {
        "op4_jaccard": JACCARD_SQL, "op6_quality": QUALITY_SQL, "op9_decontaminate": LEAKS_SQL,
        "op11_collocations": COLLOCATIONS_SQL, "op12_chosen_path": CHOSEN_PATH_SQL, "op13_merkle": MERKLE_SQL,
    }
