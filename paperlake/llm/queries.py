"""The registered queries of this subpackage: the given tables in, an operator's result mapped to its columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.alignment import align_papers, load_byte_level, load_pieces, score_links
from paperlake.llm.collocations import mine_phrases
from paperlake.llm.common import fold
from paperlake.llm.decontamination import contaminated_papers
from paperlake.llm.encoding import round_trips
from paperlake.llm.hidden_markov import score_papers
from paperlake.llm.language import fit_languages, identify_languages
from paperlake.llm.licenses import EQUIVALENT, LICENSES, scan_licenses
from paperlake.llm.minhash import sketch_duplicates
from paperlake.llm.near_duplicates import near_duplicates
from paperlake.llm.nearest import nearest_vectors
from paperlake.llm.pieces import load_vocabulary
from paperlake.llm.quality import fit_quality, rate_papers
from paperlake.llm.token_counts import count_tokens
from paperlake.llm.toxicity import fit_toxicity, score_toxicity


#: The public SentencePiece model that the queries encode with.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: The public byte-level BPE tokenizer that it is aligned with.
BYTE_LEVEL_FILE = "/opt/tokenizers/byte_bpe_50k.json"


def _papers(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as papers: paper_id and the whole text."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return documents.select(documents.doc_id.alias("paper_id"), "text")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    found = round_trips(_papers(spark, folder), load_vocabulary(MODEL_FILE))
    return found.select(F.col("paper_id").alias("doc_id"), F.size("piece_ids").alias("n_pieces"), "piece_ids", "exact")


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    papers = _papers(spark, folder).withColumn("learns", fold(F.col("paper_id"), 10) != 0)
    return score_papers(papers).withColumnRenamed("paper_id", "doc_id")


def op3_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(_papers(spark, folder)).withColumnRenamed("paper_id", "doc_id")


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    cards = benchmark.select(F.col("item_id").alias("card_id"), F.col("text").alias("front"))
    found = contaminated_papers(_papers(spark, folder), cards)
    return found.withColumnsRenamed({"paper_id": "doc_id", "card_id": "item_id"})


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_papers(spark, folder)).withColumnRenamed("paper_id", "doc_id")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(_papers(spark, folder), load_vocabulary(MODEL_FILE)).withColumnRenamed("paper_id", "doc_id")


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    papers = _papers(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ratings = labels.select(F.col("doc_id").alias("paper_id"), F.col("quality").alias("novelty_score"))
    model = fit_quality(papers, ratings.where(fold(F.col("paper_id"), 5) != 0))
    return rate_papers(papers, model).select(
        F.col("paper_id").alias("doc_id"), (fold(F.col("paper_id"), 5) == 0).alias("held_out"), "expected_grade",
        "tail_probability", "selected",
    )


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = embeddings.select(F.col("vec_id").alias("vector_id"), "embedding")
    found = nearest_vectors(vectors, vectors.where("vector_id % 50 = 0").select("vector_id"))
    return found.select("query_id", "rank", F.col("vector_id").alias("vec_id"), "score")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    papers = _papers(spark, folder)
    ratings = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("paper_id"), "toxic")
    model = fit_toxicity(papers, ratings.where(fold(F.col("paper_id"), 5) != 0))
    return score_toxicity(papers, model).select(
        F.col("paper_id").alias("doc_id"), (fold(F.col("paper_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "window_no",
    )


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labelled = documents.select(F.col("doc_id").alias("paper_id"), "text", F.col("lang").alias("language"))
    model = fit_languages(labelled.where(fold(F.col("paper_id"), 4) != 2))
    found = identify_languages(_papers(spark, folder), model)
    return found.select(
        F.col("paper_id").alias("doc_id"), (fold(F.col("paper_id"), 4) == 2).alias("held_out"),
        F.col("language").alias("lang_pred"), "score", "rejected",
    )


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    papers = documents.select(F.col("doc_id").alias("paper_id"), "text", F.col("lang").alias("language"))
    return mine_phrases(papers).withColumnRenamed("language", "lang")


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = align_papers(_papers(spark, folder), load_byte_level(BYTE_LEVEL_FILE), load_pieces(MODEL_FILE))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    scored = score_links(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return scored.select(
        F.col("paper_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op13_minhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return sketch_duplicates(_papers(spark, folder)).withColumnRenamed("paper_id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_license_scans": op3_license_scans,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_minhash_duplicates": op13_minhash_duplicates,
}

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """SQL for the canonical form of a text."""
    lines = rf"regexp_replace(lower({text}), '(?m)^[\s*#/;\-]*(copyright|©|\(c\)|all rights reserved)[^\n]*$', ' ', 'g')"
    words = rf"' ' || regexp_replace(replace({lines}, '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"
    for form, same in EQUIVALENT:
        words = f"replace({words}, ' {form} ', ' {same} ')"
    return f"trim(regexp_replace({words}, ' +', ' ', 'g'))"


_GAP = "(contains(text, chr(10) || chr(10)) OR contains(text, chr(10) || chr(13) || chr(10)))"

ORACLES: dict[str, str] = {
    "op3_license_scans": rf"""
WITH known AS (
  SELECT DISTINCT license, {_canonical("text")} AS form
  FROM (VALUES {", ".join(f"({_text(n)}, {_text(t)})" for n, t in LICENSES)}) v(license, text)
), paragraphs AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '\n\r?\n')) AS part FROM documents WHERE {_GAP}
), units AS (
  SELECT doc_id, 'text' AS scope, text AS part FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'paragraph', part FROM paragraphs
  UNION ALL SELECT doc_id, 'line', unnest(string_split(part, chr(10))) FROM (
    SELECT doc_id, part FROM paragraphs UNION ALL SELECT doc_id, text FROM documents WHERE NOT {_GAP}
  ) WHERE contains(part, chr(10))
), forms AS (SELECT doc_id, scope, {_canonical("part")} AS form FROM units)
SELECT doc_id, license, scope, count(*) AS matches FROM forms JOIN known USING (form) WHERE form <> ''
GROUP BY doc_id, license, scope
""",
    "op5_ngram_jaccard_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM sh a JOIN sh b USING (s) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other
), copies AS (
  SELECT doc_id, hash(list_sort(list(s))) AS h FROM sh GROUP BY doc_id
), counts AS (SELECT doc_id, count(*) OVER (PARTITION BY h) AS copies FROM copies)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id,
  coalesce(any_value(c.copies), 1)::BIGINT AS copies
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN counts c USING (doc_id)
GROUP BY d.doc_id, n.n
""",
    "op11_phrase_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_ASCII}),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) t(m) WHERE len(w) >= m)
), f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, n,
    (1000::HUGEINT * c.a * n // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
  JOIN total ON total.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (
    SELECT 1 FROM candidates y WHERE y.lang = x.lang AND y.phrase <> x.phrase AND 100 * y.a >= 100 * x.a
      AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
""",
    "op13_minhash_duplicates": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM sh a JOIN sh b USING (s) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
""",
}
