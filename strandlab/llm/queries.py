"""Registered queries of the operators in this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm import language_id, line_crf, pii_semicrf
from strandlab.llm.collision_ann import nearest
from strandlab.llm.html_extract import extract_pages, train_on
from strandlab.llm.lemp_negatives import hard_negatives
from strandlab.llm.license_scan import license_labels, scan_licenses
from strandlab.llm.minmax_dedup import near_duplicates
from strandlab.llm.phrase_index import collocations
from strandlab.llm.superkmer import drop_repeated_passages
from strandlab.llm.swap_packing import pack_documents
from strandlab.llm.template_decon import find_leaks
from strandlab.llm.trie_tokens import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minmax_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), similarity=85, permutations=40)


QUERIES["op1_minmax_dedup"] = op1_minmax_dedup
CHECKS["op1_minmax_dedup"] = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least_of AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)"""


def op7_superkmer_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_passages(table(spark, folder, "documents"))


QUERIES["op7_superkmer_dedup"] = op7_superkmer_dedup
CHECKS["op7_superkmer_dedup"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM twice),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)"""


def op8_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


QUERIES["op8_swap_packing"] = op8_swap_packing


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_labels(scan_licenses(table(spark, folder, "documents")))


QUERIES["op9_license_scan"] = op9_license_scan


def op10_lstm_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract_pages(pages, train_on(pages))


QUERIES["op10_lstm_extract"] = op10_lstm_extract


def op4_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = line_crf.train_on(documents, table(spark, folder, "labels"))
    return line_crf.score_documents(documents, model)


QUERIES["op4_line_crf"] = op4_line_crf


def op3_semicrf_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = pii_semicrf.find_personal_data(documents, pii_semicrf.train_on(documents))
    counts = [f"n_{k}" for k in pii_semicrf.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


QUERIES["op3_semicrf_pii"] = op3_semicrf_pii


def op5_template_decon(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES["op5_template_decon"] = op5_template_decon


def op2_collision_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES["op2_collision_ann"] = op2_collision_ann


def op6_trie_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"))


QUERIES["op6_trie_tokens"] = op6_trie_tokens


def op13_fm_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


QUERIES["op13_fm_collocations"] = op13_fm_collocations
CHECKS["op13_fm_collocations"] = r"""WITH pieces AS (SELECT lang, row_number() OVER () AS piece, p FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
    words AS (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
    grams AS (SELECT lang, w[i:i + k - 1] AS g, k FROM places, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
    f AS (SELECT lang, g, k, count(*) AS f FROM grams GROUP BY 1, 2, 3),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
    c AS (SELECT lang, g, k, f AS a FROM f WHERE k > 1 AND f >= 10),
    inside AS (SELECT lang, g[1:2] AS g, a AS rival FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE k = 3),
    kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, g, max(rival) AS rival FROM inside GROUP BY 1, 2) x USING (lang, g)
        WHERE x.rival IS NULL OR 100 * x.rival < 50 * a),
    cuts AS (SELECT lang, g, a, cut, g[1:cut] AS x, g[cut + 1:k] AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
    scored AS (SELECT cuts.*, p.f AS l, q.f AS r, (1000000::HUGEINT * a * a // (p.f::HUGEINT * q.f))::BIGINT AS score
        FROM cuts JOIN f p ON p.lang = cuts.lang AND p.g = x JOIN f q ON q.lang = cuts.lang AND q.g = y),
    weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
    FROM weakest JOIN n USING (lang) QUALIFY rank <= 2000"""


def op12_lemp_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


QUERIES["op12_lemp_negatives"] = op12_lemp_negatives
CHECKS["op12_lemp_negatives"] = r"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    met AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN met USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3"""


def op11_subword_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return language_id.identify(documents, language_id.train_on(documents))


QUERIES["op11_subword_language"] = op11_subword_language
