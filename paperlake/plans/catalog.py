"""Registered queries: each operator on the bound test tables, next to its independent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.functions import urls as U
from paperlake.operators import export as E
from paperlake.operators import highlights as H
from paperlake.operators import inference as L
from paperlake.operators import knowledge as K
from paperlake.operators import lifecycle as M
from paperlake.operators import notes as N
from paperlake.operators import queries as Q
from paperlake.operators import srs as R
from paperlake.operators import text as T
from paperlake.operators.search import TextIndex
from paperlake.plans import extraction as P
from paperlake.plans.bindings import NOW, Tables, now
from paperlake.plans.oracles import APPEARS_IN, HEADINGS, ORPHAN_MESSAGE, RELATED, OMITTED, STAMP, _bib, _id, _safe, _sanitize, _squeeze, _strip, _unwrap_once, _yaml, sql
from paperlake.schemas import DOCUMENT
from paperlake.session import new_path, stored
from paperlake.sources import documents as D
from paperlake.sources.answers import AnswerTable, answer_requests, calls_made
from paperlake.sources.dictionary import dictionary, merge_papers, papers_of_entities
from paperlake.sources.mapping import read_mapping, upsert_notes
from paperlake.sources.note_files import read_note_heads, write_note_files
from paperlake.sources import files as S
from paperlake.streaming.reviews import apply_reviews, latest_state_stream
from paperlake.streaming.run import latest_rows

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


# ---- sources and sinks ----------------------------------------------------------------------------------------


def _payload_bytes() -> Column:
    return F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), F.col("text"))).when(
        F.col("doc_id") % 7 == 1, F.lit("")
    ).otherwise(F.col("text"))


_BYTES = "CASE WHEN doc_id % 3 = 0 THEN '%PDF-1.7 ' || text WHEN doc_id % 7 = 1 THEN '' ELSE text END"


@query(
    "s1_accept_files",
    f"""WITH f AS (SELECT doc_id, encode({_BYTES}) AS b FROM documents),
    g AS (SELECT doc_id, CASE WHEN octet_length(b) = 0 THEN 'empty' WHEN octet_length(b) > 10485.76 THEN 'too_large'
      WHEN NOT starts_with(hex(b), '25504446') THEN 'not_pdf' END AS reject_reason FROM f)
    SELECT doc_id, coalesce(reject_reason, '') AS reject_reason, reject_reason IS NULL AS accepted FROM g""",
)
def s1(t: Tables) -> DataFrame:
    files = t.documents().select("doc_id", F.encode(_payload_bytes(), "UTF-8").alias("content"))
    return S.accept_files(files, max_mb=0.01).select(
        "doc_id", E.text_or_empty("reject_reason").alias("reject_reason"), "accepted"
    )


@query(
    "s2_decode_payload",
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'invalid_base64'
      WHEN NOT starts_with({_BYTES}, '%PDF') THEN 'not_pdf' ELSE '' END AS reject_reason,
      CASE WHEN doc_id % 5 = 4 THEN -1 ELSE strlen({_BYTES}) END AS n_bytes FROM documents""",
)
def s2(t: Tables) -> DataFrame:
    # Every fifth payload has a blank in it, which a lenient decoder would accept.
    b64 = F.replace(F.base64(F.encode(_payload_bytes(), "UTF-8")), F.lit("\r\n"), F.lit(""))
    sent = t.documents().withColumn("b64", F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit(" "), b64)).otherwise(b64))
    return S.decode_payload(sent).select(
        "doc_id",
        E.text_or_empty("reject_reason").alias("reject_reason"),
        F.coalesce(F.octet_length("content"), F.lit(-1)).cast("bigint").alias("n_bytes"),
    )


@query("s3_assemble_text", sql("texts", "SELECT paper_id, n_pages, text FROM texts"))
def s3(t: Tables) -> DataFrame:
    return t.texts().select("paper_id", F.col("n_pages").cast("bigint").alias("n_pages"), "text")


@query(
    "s4_note_front_matter",
    sql("papers", "SELECT paper_id, title, coalesce(doi, '') AS doi, abstract FROM (SELECT paper_id, title, doi, coalesce(abstract, '') AS abstract FROM papers)"),
)
def s4(t: Tables) -> DataFrame:
    abstract = F.coalesce("metadata.abstract", F.lit(""))
    note = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), X.yaml_quote(F.col("title"))),
        F.concat(F.lit(" doi : "), F.col("doi")), F.lit("no colon"),
        F.concat(F.lit("abstract: "), X.yaml_quote(abstract)), F.lit("---"), F.lit("body: x"),
    )
    m = F.col("m")
    return t.papers().select("paper_id", S.front_matter(note).alias("m")).select(
        "paper_id", m["title"].alias("title"), E.text_or_empty(m["doi"]).alias("doi"), m["abstract"].alias("abstract")
    )


@query(
    "s5_document_round_trip",
    sql("ents done", "SELECT paper_id, id, name, type, importance FROM (SELECT paper_id, id, name, type, round(importance, 6) AS importance FROM ents SEMI JOIN done USING (paper_id))"),
)
def s5(t: Tables) -> DataFrame:
    """Tables to JSON documents and back."""
    docs = D.assemble_documents(t.knowledge(keep=True), now(), "m")
    back = D.to_tables(D.parse_knowledge(docs))
    return back.entities.select("paper_id", "id", "name", "type", r6("importance"))


@query(
    "s7_align_schema",
    "SELECT o_orderkey, 'translate' AS mode, CAST(NULL AS VARCHAR) AS summary_json, CAST(o_totalprice AS BIGINT) AS o_totalprice FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders)",
)
def s7(t: Tables) -> DataFrame:
    old = t.read("orders").select("o_orderkey", "o_totalprice")
    return S.align_schema(
        old, "o_orderkey BIGINT, mode STRING, summary_json STRING, o_totalprice BIGINT", {"mode": "translate"}
    )


@query(
    "s7_read_versions",
    """SELECT o_orderkey, CAST(o_orderkey % 3 + 1 AS INTEGER) AS version, CASE o_orderkey % 3 WHEN 0 THEN 'translate' ELSE o_orderpriority END AS mode,
      CASE o_orderkey % 3 WHEN 2 THEN o_orderkey % 2 = 0 ELSE false END AS highlight, CAST(o_custkey AS BIGINT) AS user_id FROM orders""",
)
def s7_versions(t: Tables) -> DataFrame:
    """Orders written as three versions of a table: without modes, with them, with one more column and wider numbers."""
    path, orders = new_path(t.spark, "versions"), t.read("orders")
    mode, third = F.col("o_orderpriority").alias("mode"), F.col("o_orderkey") % 3
    narrow = F.col("o_custkey").cast("int").alias("user_id")
    highlight = (F.col("o_orderkey") % 2 == 0).alias("highlight")
    versions = {
        1: ["o_orderkey", narrow], 2: ["o_orderkey", narrow, mode],
        3: ["o_orderkey", F.col("o_custkey").alias("user_id"), mode, highlight],
    }
    for version, columns in versions.items():
        orders.filter(third == version - 1).select(*columns).write.parquet(f"{path}/version={version}")
    return S.read_versions(
        t.spark, path, "o_orderkey BIGINT, user_id BIGINT, mode STRING, highlight BOOLEAN",
        {1: {"mode": "translate", "highlight": False}, 2: {"highlight": False}},
    )


# ---- text -----------------------------------------------------------------------------------------------------


@query(
    "t1_unwrap_lines",
    f"SELECT doc_id, replace({_unwrap_once(_unwrap_once('text'))}, chr(10), '') AS text FROM documents",
)
def t1(t: Tables) -> DataFrame:
    return T.unwrap_lines(t.documents())


@query("t2_sentences", sql("sentences", "SELECT doc_id, n AS sentence_no, text FROM sentences"))
def t2(t: Tables) -> DataFrame:
    return T.sentences(t.documents()).select("doc_id", F.col("sentence_no").cast("bigint").alias("sentence_no"), "text")


@query(
    "t3_sentence_ids",
    sql("sentences", "SELECT doc_id, 'p1_s' || n AS sentence_id, length(text) AS chars FROM sentences"),
)
def t3(t: Tables) -> DataFrame:
    return T.sentences(t.documents()).select(
        "doc_id", "sentence_id", F.length("text").cast("bigint").alias("chars")
    )


@query(
    "t4_pack_chunks",
    sql("packed", "SELECT doc_id, 'p1_s' || n AS sentence_id, CAST(chunk_no AS BIGINT) AS chunk_no FROM packed"),
)
def t4(t: Tables) -> DataFrame:
    return T.pack_chunks(t.documents()).select(
        "doc_id", "sentence_id", F.col("chunk_no").cast("bigint").alias("chunk_no")
    )


@query(
    "t5_split_sections",
    sql("cut", "SELECT paper_id, unnest(chunks) AS text, generate_subscripts(chunks, 1) - 1 AS chunk_no FROM cut"),
)
def t5(t: Tables) -> DataFrame:
    return T.split_sections(t.plain_texts(), t.section_titles()).select(
        "paper_id", "text", F.col("chunk_no").cast("bigint").alias("chunk_no")
    )


@query(
    "t6_select_chunks",
    sql(
        "cut",
        f"""SELECT paper_id, unnest(k) AS text, generate_subscripts(k, 1) - 1 AS chunk_no FROM (
        SELECT paper_id, CASE WHEN len(kept) > 0 THEN kept ELSE [substr(text, 1, 6000)] END AS k FROM (
        SELECT paper_id, text, list_filter(chunks, lambda c: length({_strip('c')}) >= 100) AS kept FROM cut))""",
    ),
)
def t6(t: Tables) -> DataFrame:
    return T.select_chunks(t.plain_texts(), t.section_titles()).select(
        "paper_id", "text", F.col("chunk_no").cast("bigint").alias("chunk_no")
    )


@query("t7_contexts", sql("texts", "SELECT paper_id, first_pages, substr(text, 1, 8000) AS prefix FROM texts"))
def t7(t: Tables) -> DataFrame:
    return T.contexts(t.texts())


@query(
    "t8_budget_context",
    f"""SELECT doc_id AS paper_id, CASE WHEN length(text) <= 20000 THEN text ELSE substr(text, 1, 12000) || '{OMITTED}'
    || substr(text, length(text) - 7999) END AS context FROM documents""",
)
def t8(t: Tables) -> DataFrame:
    return T.budget_context(t.plain_texts())


@query(
    "t9_normalize_tags",
    f"""SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(text, ','),
    lambda x: {_strip('x')}), lambda x: x <> ''), '|'), '') AS tags FROM documents""",
)
def t9(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", F.array_join(X.normalize_tags(F.col("text")), "|").alias("tags"))


_PADDED = "chr(160) || CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || ' ' || chr(9)"


def _padded_names(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return t.read("part").select("p_partkey", "p_type", F.concat(F.lit(" "), name, F.lit(" \t")).alias("name"))


@query("t10_key_simple", f"SELECT p_partkey, {_strip(f'lower({_PADDED})')} AS entity_key FROM part")
def t10(t: Tables) -> DataFrame:
    return _padded_names(t).select("p_partkey", X.key_simple(F.col("name")).alias("entity_key"))


@query(
    "t11_key_nfkc",
    f"SELECT p_partkey, {_squeeze(f'lower({_PADDED})')} || ' bert' AS entity_key FROM part",
)
def t11(t: Tables) -> DataFrame:
    wide = F.concat("name", F.lit("ＢＥＲＴ"))
    return _padded_names(t).select("p_partkey", X.key_nfkc(wide).alias("entity_key"))


_NAME = "p_name || '/' || p_type || ' [' || p_brand || ']: ' || repeat('x', CAST(p_partkey % 140 AS INTEGER)) || ' ..'"


def _odd_names(t: Tables) -> DataFrame:
    x = F.repeat(F.lit("x"), (F.col("p_partkey") % 140).cast("int"))
    name = F.concat("p_name", F.lit("/"), "p_type", F.lit(" ["), "p_brand", F.lit("]: "), x, F.lit(" .."))
    return t.read("part").select("p_partkey", name.alias("name"))


@query("t12_sanitize_name", f"SELECT p_partkey, {_sanitize(_NAME)} AS name FROM part")
def t12(t: Tables) -> DataFrame:
    return _odd_names(t).select("p_partkey", X.sanitize_name(F.col("name")).alias("name"))


@query("t13_safe_filename", f"SELECT p_partkey, {_safe(_NAME)} AS name FROM part")
def t13(t: Tables) -> DataFrame:
    return _odd_names(t).select("p_partkey", X.safe_filename(F.col("name")).alias("name"))


_ODD = "text || ' \\ \"q\" & % $ # _ { } ~ ^'"


@query("t14_escapes", f"SELECT doc_id, {_yaml(_ODD)} AS yaml, {_bib(_ODD)} AS bibtex FROM documents")
def t14(t: Tables) -> DataFrame:
    c = F.concat("text", F.lit(' \\ "q" & % $ # _ { } ~ ^'))
    return t.documents().select("doc_id", X.yaml_quote(c).alias("yaml"), X.bibtex_escape(c).alias("bibtex"))


@query(
    "t15_cite_key",
    "SELECT doc_id, coalesce(nullif(regexp_replace(text, '[^A-Za-z0-9_:-]', '', 'g'), ''), 'ref') AS cite_key FROM documents",
)
def t15(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", X.cite_key(F.col("text")).alias("cite_key"))


@query(
    "t16_split_name",
    f"""SELECT p_partkey, CASE WHEN len(w) >= 2 THEN array_to_string(w[1:len(w) - 1], ' ') ELSE n END AS given,
    CASE WHEN len(w) >= 2 THEN w[len(w)] ELSE '' END AS family FROM (SELECT p_partkey, n, string_split({_squeeze('n')}, ' ') AS w
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_name
    ELSE ' ' || p_name || '  ' || p_brand END AS n FROM part))""",
)
def t16(t: Tables) -> DataFrame:
    n = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(
        F.concat(F.lit(" "), "p_name", F.lit("  "), "p_brand")
    )
    return t.read("part").select("p_partkey", F.inline(F.array(X.split_name(n))))


# ---- model inference ------------------------------------------------------------------------------------------


@query(
    "l1_text_requests",
    sql(
        "texts",
        f"""SELECT paper_id, 'metadata' AS task, first_pages AS content FROM texts
        UNION ALL SELECT paper_id, 'sections', substr(text, 1, 8000) FROM texts
        UNION ALL SELECT paper_id, 'findings', substr(text, 1, 8000) FROM texts
        UNION ALL SELECT paper_id, 'summary', 'Paper text:' || chr(10) || chr(10) || CASE WHEN length(text) <= 20000 THEN text
          ELSE substr(text, 1, 12000) || '{OMITTED}' || substr(text, length(text) - 7999) END FROM texts""",
    ),
)
def l1(t: Tables) -> DataFrame:
    return L.text_requests(t.texts(), first_slice_only=True).select("paper_id", "task", "content")


@query(
    "l1_entity_requests",
    sql(
        "cut",
        f"""SELECT paper_id, generate_subscripts(k, 1) - 1 AS chunk_no, unnest(k) AS content FROM (
        SELECT paper_id, CASE WHEN len(kept) > 0 THEN kept ELSE [substr(text, 1, 6000)] END AS k FROM (
        SELECT paper_id, text, list_filter(chunks, lambda c: length({_strip('c')}) >= 100) AS kept FROM cut))""",
    ),
)
def l1_entities(t: Tables) -> DataFrame:
    chunks = T.select_chunks(t.plain_texts(), t.section_titles())
    return L.entity_requests(chunks).select("paper_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "content")


@query(
    "l1_highlight_requests",
    sql(
        "packed sentences",
        """SELECT doc_id AS paper_id, CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n,
        sum(length(substr(text, 1, 800)))::BIGINT AS chars, min('p1_s' || n) AS first_id
        FROM packed JOIN sentences USING (doc_id, n) GROUP BY ALL""",
    ),
)
def l1_highlight(t: Tables) -> DataFrame:
    """Requests, read back from their JSON."""
    requests = L.highlight_requests(T.pack_sentence_chunks(t.documents()), sentence_chars=800)
    body = F.substring("content", len(L.HIGHLIGHT_PREFIX) + 1, 2**31 - 1)
    items = F.from_json(body, "array<struct<sentence_id: string, page: int, text: string>>")
    rows = requests.select("paper_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), items.alias("items"))
    return rows.select(
        "paper_id", "chunk_no", F.size("items").cast("bigint").alias("n"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["text"])).alias("chars"),
        F.array_min(F.transform("items", lambda x: x["sentence_id"])).alias("first_id"),
    )


@query(
    "l1_card_requests",
    sql(
        "ents findings",
        """SELECT paper_id, ne AS entities, coalesce(nf, 0) AS findings, e1 AS first_entity, coalesce(f1, '') AS first_finding FROM
        (SELECT paper_id, least(count(*), 15) AS ne, arg_min(name, first_chunk * 1000000000000 + first_pos) AS e1 FROM ents GROUP BY 1)
        LEFT JOIN (SELECT paper_id, least(count(*), 10) AS nf, arg_min(statement, pos) AS f1 FROM findings GROUP BY 1) USING (paper_id)""",
    ),
)
def l1_cards(t: Tables) -> DataFrame:
    requests = L.card_requests(t.entities(), t.knowledge().findings, first=(15, 10))
    parsed = F.from_json("content", "entities array<struct<name: string>>, findings array<struct<statement: string>>")
    rows = requests.select("paper_id", parsed.alias("p"))
    return rows.select(
        "paper_id", F.size("p.entities").cast("bigint").alias("entities"), F.size("p.findings").cast("bigint").alias("findings"),
        F.get("p.entities", F.lit(0))["name"].alias("first_entity"),
        E.text_or_empty(F.get("p.findings", F.lit(0))["statement"]).alias("first_finding"),
    )


@query(
    "l1_whole_text_requests",
    sql(
        "texts",
        f"""SELECT paper_id, 'metadata' AS task, 0 AS chunk_no, first_pages AS content FROM texts
        UNION ALL SELECT paper_id, task, CAST(i AS INTEGER), substr(text, i * 8000 + 1, 8000) FROM (
          SELECT paper_id, task, text, unnest(range(0, greatest(1, (length(text) + 7999) // 8000))) AS i
          FROM texts, unnest(['sections', 'findings']) AS u(task))
        UNION ALL SELECT paper_id, 'summary', 0, 'Paper text:' || chr(10) || chr(10) || CASE WHEN length(text) <= 20000 THEN text
          ELSE substr(text, 1, 12000) || '{OMITTED}' || substr(text, length(text) - 7999) END FROM texts""",
    ),
)
def l1_whole(t: Tables) -> DataFrame:
    """Sections and findings are asked for over whole texts, a request for each slice."""
    return L.text_requests(t.texts()).select("paper_id", "task", "chunk_no", "content")


@query(
    "l1_whole_highlight_requests",
    sql(
        "packed sentences",
        """SELECT doc_id AS paper_id, CAST(chunk_no AS BIGINT) AS chunk_no, string_agg('p1_s' || n || ' 1 ' || text, chr(10) ORDER BY n) AS items
        FROM packed JOIN sentences USING (doc_id, n) GROUP BY ALL""",
    ),
)
def l1_whole_highlight(t: Tables) -> DataFrame:
    """Requests with whole sentences, read back from their JSON."""
    requests = L.highlight_requests(T.pack_sentence_chunks(t.documents()))
    body = F.substring("content", len(L.HIGHLIGHT_PREFIX) + 1, 2**31 - 1)
    items = F.from_json(body, "array<struct<sentence_id: string, page: int, text: string>>")
    line = lambda x: F.concat_ws(" ", x["sentence_id"], x["page"].cast("string"), x["text"])
    return requests.select(
        "paper_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.array_join(F.transform(items, line), "\n").alias("items")
    )


@query(
    "l1_whole_card_requests",
    sql(
        "ents findings",
        """SELECT paper_id, CAST(chunk_no AS BIGINT) AS chunk_no, coalesce(e, '') AS entities, coalesce(f, '') AS findings FROM
        (SELECT paper_id, first_chunk AS chunk_no, string_agg(name, '|' ORDER BY first_pos) AS e FROM ents GROUP BY ALL)
        FULL JOIN (SELECT paper_id, 0 AS chunk_no, string_agg(statement, '|' ORDER BY pos) AS f FROM findings GROUP BY ALL) USING (paper_id, chunk_no)""",
    ),
)
def l1_whole_cards(t: Tables) -> DataFrame:
    """All entities and findings of every paper, a request for each chunk they come from."""
    requests = L.card_requests(t.entities(), t.knowledge().findings)
    parsed = F.from_json("content", "entities array<struct<name: string>>, findings array<struct<statement: string>>")
    rows = requests.select("paper_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), parsed.alias("p"))
    return rows.select(
        "paper_id", "chunk_no", F.array_join("p.entities.name", "|").alias("entities"),
        F.array_join("p.findings.statement", "|").alias("findings"),
    )


def _stand_in():
    """A model that answers with what it was asked, and fails on the first try of every third request length."""

    class StandIn:
        def __init__(self) -> None:
            self.tried: set[str] = set()

        def complete(self, system: str, content: str, temperature: float, max_tokens: int, json_mode: bool) -> str:
            import json

            if len(content) % 3 == 0 and content not in self.tried:
                self.tried.add(content)
                raise TimeoutError("busy")
            self.tried.discard(content)
            return json.dumps({"one_liner": content[-20:], "novelty_score": len(content)})

    return StandIn


@query(
    "l2_infer",
    f"""SELECT paper_id, right(c, 20) AS one_liner, length(c) AS novelty_score, CASE WHEN length(c) % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM (
    SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'Paper text:' || chr(10) || chr(10) || CASE WHEN length(text) <= 20000 THEN text
      ELSE substr(text, 1, 12000) || '{OMITTED}' || substr(text, length(text) - 7999) END AS c FROM documents)""",
)
def l2(t: Tables) -> DataFrame:
    """Summary requests of all documents, answered by a stand-in model and read back."""
    texts = t.plain_texts().withColumn("page_texts", F.array("text"))
    requests = L.text_requests(texts).filter("task = 'summary'")
    answers = L.parse_response(L.infer(requests, _stand_in(), sleep=lambda seconds: None), "summary")
    return answers.select(
        "paper_id", "parsed.one_liner", F.col("parsed.novelty_score").cast("bigint").alias("novelty_score"), "attempts"
    )


@query(
    "l2_kept_answers",
    f"""WITH asked AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'Paper text:' || chr(10) || chr(10) || CASE WHEN length(text) <= 20000 THEN text
        ELSE substr(text, 1, 12000) || '{OMITTED}' || substr(text, length(text) - 7999) END AS c FROM documents),
      known AS (SELECT DISTINCT c FROM asked WHERE CAST(paper_id AS BIGINT) % 3 <> 0)
    SELECT paper_id, right(c, 20) AS one_liner, length(c) AS novelty_score, c IN (FROM known) AS reused,
      (SELECT count(DISTINCT c) FROM asked WHERE c NOT IN (FROM known))::BIGINT AS calls FROM asked""",
)
def l2_kept(t: Tables) -> DataFrame:
    """Two runs over one table of answers: the second has a third of the documents more, and asks for those only."""
    requests = L.text_requests(t.plain_texts().withColumn("page_texts", F.array("text")), ("summary",))
    path = new_path(t.spark, "answers")
    first, second = (AnswerTable(t.spark, path, "stand-in", run) for run in ("first", "second"))
    answer_requests(requests.filter("paper_id % 3 <> 0"), _stand_in(), first, sleep=lambda seconds: None)
    answers = answer_requests(requests, _stand_in(), second, sleep=lambda seconds: None)
    parsed = L.parse_response(answers, "summary").join(calls_made(second).select("task", "requests"), "task", "left")
    return parsed.select(
        "paper_id", "parsed.one_liner", F.col("parsed.novelty_score").cast("bigint").alias("novelty_score"), "reused",
        F.coalesce("requests", F.lit(0)).alias("calls"),
    )


def _reader():
    """A model that reads what it is sent: its first and last word, how long it is, the first sentence it is offered."""

    class Reader:
        def complete(self, system: str, content: str, temperature: float, max_tokens: int, json_mode: bool) -> str:
            import json

            if '"sections"' in system:
                return json.dumps({"sections": []})
            if '"entities"' in system:
                first, last = content.split()[0], content.split()[-1]
                return json.dumps({"entities": [{"name": first}, {"name": last}], "relationships": [{"source": first, "target": last}]})
            if '"findings"' in system:
                return json.dumps({"findings": [{"statement": content[:5]}], "methods": [{"name": str(len(content))}], "datasets": []})
            if '"flashcards"' in system:
                asked = json.loads(content)
                return json.dumps({"flashcards": [{"front": str(len(asked["entities"])), "back": str(len(asked["findings"]))}]})
            if '"highlights"' in system:
                asked = json.loads(content.split("\n\n", 1)[1])
                chosen = [{"sentence_id": asked[0]["sentence_id"], "category": "key_data"}]
                return "```json\n" + json.dumps({"highlights": chosen}) + "\n```"
            if "plain everyday" in system:
                return content.lower()
            return json.dumps({"title": content[:10], "one_liner": content[:30]})

    return Reader


@query(
    "x1_extract",
    """WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, text, length(text) AS n,
      regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+') AS words FROM documents)
    SELECT paper_id, substr(text, 1, 10) AS title, 'completed' AS extraction_status, CAST(0 AS BIGINT) AS failed_calls,
      CASE WHEN lower(words[1]) = lower(words[-1]) THEN 1 ELSE 2 END::BIGINT AS entities, CAST(1 AS BIGINT) AS relations,
      ((n + 7999) // 8000)::BIGINT AS findings, n::BIGINT AS read, ((n + 7999) // 8000)::BIGINT AS cards FROM w""",
)
def x1(t: Tables) -> DataFrame:
    """Three waves of inference over whole documents, with a model that reads what it is sent."""
    texts = t.plain_texts().withColumn("page_texts", F.array("text"))
    papers = t.documents().select(F.col("doc_id").cast("string").alias("paper_id"), F.lit(1).cast("bigint").alias("user_id"), now().alias("created_at"))
    kb, _ = P.extract(texts, papers, _reader(), now())
    counts = Q.paper_counts(kb.papers, kb.entities, kb.findings, kb.cards, kb.relations)
    read = kb.methods.groupBy("paper_id").agg(F.sum(F.col("name").cast("bigint")).alias("read"))
    return kb.papers.join(counts, "paper_id").join(read, "paper_id").select(
        "paper_id", "title", "extraction_status", "failed_calls", "entities", F.col("relationships").alias("relations"), "findings", "read", "cards"
    )


_UNWRAPPED = sql(
    "packed",
    """SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(n, 0)::BIGINT AS chosen, coalesce(n, 0)::BIGINT AS total,
      CAST(0 AS BIGINT) AS failed_matches, CASE WHEN n > 0 THEN 'success' ELSE 'failed' END AS status
    FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT chunk_no) AS n FROM packed GROUP BY 1) USING (doc_id)""",
).replace("FROM documents", "FROM unwrapped").replace(
    "WITH RECURSIVE ",
    f"WITH RECURSIVE unwrapped AS (SELECT doc_id, replace({_unwrap_once(_unwrap_once('text'))}, chr(10), '') AS text FROM documents), ", 1,
)


@query("x2_highlight", _UNWRAPPED)
def x2(t: Tables) -> DataFrame:
    """Key sentences of unwrapped documents: the first of every chunk, and the status of each document."""
    applied, stats = P.highlight(t.documents(), _reader())
    chosen = applied.filter("matched").groupBy("doc_id").agg(F.count("*").alias("chosen"))
    return stats.join(chosen, "doc_id", "left").select("doc_id", F.coalesce("chosen", F.lit(0)).alias("chosen"), "total", "failed_matches", "status")


@query(
    "x3_summarise",
    """SELECT CAST(doc_id AS VARCHAR) AS paper_id, substr('Paper text:' || chr(10) || chr(10) || text, 1, 30) AS one_liner, '' AS summary_error FROM documents""",
)
def x3(t: Tables) -> DataFrame:
    texts = t.plain_texts().withColumn("page_texts", F.array("text"))
    found = P.summarise(texts, _reader())
    return found.select("paper_id", "summary.one_liner", E.text_or_empty("summary_error").alias("summary_error"))


@query(
    "x4_simplify",
    """SELECT CAST(doc_id AS VARCHAR) AS paper_id, i::BIGINT AS chunk_no, lower(substr(text, i * 2000 + 1, 2000)) AS body
    FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1999) // 2000)) AS i FROM documents)""",
)
def x4(t: Tables) -> DataFrame:
    """Every slice of every document in plain words; what stands between the template's parts is compared."""
    # An empty text has no slices; a sequence would not go from 0 to -1.
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(2000)))
    cut = F.transform(starts, lambda at: F.substring("text", at + 1, F.lit(2000)))
    chunks = t.documents().select(F.col("doc_id").alias("paper_id"), F.posexplode(cut).alias("chunk_no", "text"))
    body = F.regexp_extract("text", r"(?s)\n\ntext: (.*)\n\nrewritten:\z", 1)
    return P.simplify(chunks, _reader()).select("paper_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), body.alias("body"))


@query(
    "l3_parse_response",
    """SELECT conv_id AS paper_id, turn AS chunk_no, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS one_liner,
    CASE WHEN turn % 5 = 4 THEN -1 ELSE turn END AS novelty_score, turn % 5 = 4 AS parse_failed FROM conversations""",
)
def l3(t: Tables) -> DataFrame:
    parsed = L.parse_response(t.text_answers(), "summary")
    return parsed.select(
        "paper_id", "chunk_no", E.text_or_empty("parsed.one_liner").alias("one_liner"),
        F.coalesce(F.col("parsed.novelty_score").cast("bigint"), F.lit(-1)).alias("novelty_score"), "parse_failed",
    )


@query(
    "l3_answer_fields",
    "SELECT 'summary' AS task, 'OBJECT<novelty_score: BIGINT, one_liner: STRING>' AS schema WHERE EXISTS (SELECT 1 FROM conversations WHERE turn % 5 <> 4)",
)
def l3_fields(t: Tables) -> DataFrame:
    """What the answers hold, whatever the schema they are read with."""
    return L.answer_fields(t.text_answers())


@query("l4_selections", sql("sel", "SELECT doc_id, sentence_id, category FROM sel"))
def l4(t: Tables) -> DataFrame:
    return _selections(t).select("doc_id", "sentence_id", "category")


def _selections(t: Tables) -> DataFrame:
    return H.selections(L.parse_response(t.highlight_answers(), "highlight"))


# ---- knowledge ------------------------------------------------------------------------------------------------


@query(
    "k1_entity_mentions",
    sql(
        "items hubs",
        """SELECT paper_id, chunk_no, 0 AS pos, p_name AS name, lower(p_type) AS type, p_brand AS definition, l_discount AS importance FROM items
        UNION ALL SELECT paper_id, chunk_no, 1, upper(hub), '', '', -1.0 FROM items JOIN hubs USING (paper_id)""",
    ),
)
def k1(t: Tables) -> DataFrame:
    mentions = K.entity_mentions(L.parse_response(t.entity_answers(), "entities"))
    return mentions.select(
        "paper_id", "chunk_no", "pos", "name", E.text_or_empty("type").alias("type"),
        E.text_or_empty("definition").alias("definition"), F.coalesce("importance", F.lit(-1.0)).alias("importance"),
    )


@query(
    "k1_relation_mentions",
    sql("items hubs", "SELECT paper_id, chunk_no, p_name AS source, hub AS target, 'near' AS type FROM items JOIN hubs USING (paper_id)"),
)
def k1_relations(t: Tables) -> DataFrame:
    mentions = K.relation_mentions(L.parse_response(t.entity_answers(), "entities"))
    return mentions.select("paper_id", "chunk_no", "source", "target", "type")


_ENT_COLS = "paper_id, entity_key, name, type, coalesce(alias, '') AS aliases, definition"


@query(
    "k2_dedup_entities",
    sql("ranked", f"SELECT {_ENT_COLS}, round(coalesce(importance, -1), 6) AS importance, first_chunk, first_pos FROM ranked WHERE rk = 1"),
)
def k2(t: Tables) -> DataFrame:
    return K.dedup_entities(t.mentions()).select(
        "paper_id", "entity_key", "name", "type", F.coalesce(F.array_join("aliases", ","), F.lit("")).alias("aliases"),
        "definition", F.round(F.coalesce("importance", F.lit(-1.0)), 6).alias("importance"), "first_chunk", "first_pos",
    )


@query("k3_entity_index", sql("ents", f"SELECT {_ENT_COLS}, round(importance, 6) AS importance, id FROM ents"))
def k3(t: Tables) -> DataFrame:
    return t.entities().select(
        "paper_id", "entity_key", "name", "type", F.array_join("aliases", ",").alias("aliases"), "definition",
        r6("importance"), "id",
    )


@query(
    "k4_resolve_relations",
    sql("rels", "SELECT paper_id, id, source, target, type, description, round(confidence, 6) AS confidence, source_entity_id, target_entity_id FROM rels"),
)
def k4(t: Tables) -> DataFrame:
    return t.relations().select(
        "paper_id", "id", "source", "target", "type", "description", r6("confidence"), "source_entity_id", "target_entity_id"
    )


def _item_answers(t: Tables, task: str, payload: Column) -> DataFrame:
    """One answer per paper row, for the operators that flatten findings, sections and cards."""
    return t.papers().select("paper_id", F.lit(task).alias("task"), F.lit(0).alias("chunk_no"), F.to_json(payload).alias("raw"))


@query(
    "k5_sections",
    sql(
        "papers",
        """SELECT paper_id, 'sec_' || i AS id, CAST(i AS BIGINT) AS section_no, CASE i WHEN 1 THEN title ELSE venue END AS title,
        CAST(i AS INTEGER) AS level FROM papers, (SELECT unnest([1, 2]) AS i)""",
    ),
)
def k5_sections(t: Tables) -> DataFrame:
    section = lambda title, level: F.struct(F.col(title).alias("title"), F.lit(level).alias("level"))
    answers = _item_answers(t, "sections", F.struct(F.array(section("title", 1), section("venue", 2)).alias("sections")))
    return K.sections(L.parse_response(answers, "sections")).select("paper_id", "id", "section_no", "title", "level")


def _finding_answers(t: Tables) -> DataFrame:
    payload = F.struct(
        F.array(F.struct(F.col("title").alias("statement"), F.lit("main_result").alias("type"), F.col("venue").alias("evidence"))).alias("findings"),
        F.array(F.struct(F.col("venue").alias("name"), F.array("title").alias("inputs"))).alias("methods"),
        F.array(F.struct(F.col("title").alias("name"), F.col("doi").alias("usage"))).alias("datasets"),
    )
    return L.parse_response(_item_answers(t, "findings", payload), "findings")


@query(
    "k5_findings",
    sql("papers", f"SELECT paper_id, {_id('find', 'paper_id', chr(39) + '0' + chr(39))} AS id, title AS statement, venue AS evidence FROM papers"),
)
def k5_findings(t: Tables) -> DataFrame:
    return K.findings(_finding_answers(t)).select("paper_id", "id", "statement", "evidence")


@query("k5_methods", sql("papers", "SELECT paper_id, venue AS name, title AS inputs FROM papers"))
def k5_methods(t: Tables) -> DataFrame:
    return K.methods(_finding_answers(t)).select("paper_id", "name", F.array_join("inputs", ",").alias("inputs"))


@query("k5_datasets", sql("papers", "SELECT paper_id, title AS name, coalesce(doi, '') AS usage FROM papers"))
def k5_datasets(t: Tables) -> DataFrame:
    return K.datasets(_finding_answers(t)).select("paper_id", "name", E.text_or_empty("usage").alias("usage"))


@query(
    "k6_new_cards",
    sql(
        "papers",
        f"""SELECT paper_id, {_id('fc', 'paper_id', chr(39) + '0' + chr(39))} AS id, title AS front, '' AS back, '' AS tags,
        3 AS difficulty, CAST(1.0 AS DOUBLE) AS interval_days, CAST(2.5 AS DOUBLE) AS ease_factor, 0 AS repetitions,
        '{NOW}' AS next_review FROM papers""",
    ),
)
def k6(t: Tables) -> DataFrame:
    answers = _item_answers(t, "flashcards", F.struct(F.array(F.struct(F.col("title").alias("front"))).alias("flashcards")))
    cards = K.new_cards(L.parse_response(answers, "flashcards"), now())
    return cards.select(
        "paper_id", "id", "front", "back", F.array_join("tags", ",").alias("tags"), "difficulty", "interval_days",
        "ease_factor", "repetitions", stamp("next_review"),
    )


def _listed(part: str, value: str, order: str, where: str = "") -> str:
    """SQL for the values of a part of each paper in order, as one text."""
    return f"(SELECT paper_id, string_agg({value}, '|' ORDER BY {order}) AS v FROM {part} {where} GROUP BY 1)"


@query(
    "k7_assemble_documents",
    sql(
        "done ents rels findings items kcards",
        f"""SELECT paper_id, title, coalesce(e.v, '') AS entities, coalesce(r.v, '') AS relationships, coalesce(f.v, '') AS findings,
          coalesce(m.v, '') AS methods, coalesce(d.v, '') AS datasets, coalesce(c.v, '') AS cards, coalesce(s.v, '') AS sections
        FROM done
        LEFT JOIN {_listed("ents", "id || ' ' || name || ' ' || type || ' ' || coalesce(alias, '') || ' ' || definition || ' ' || CAST(CAST(round(importance * 1000) AS INTEGER) AS VARCHAR)", "first_chunk, first_pos")} e USING (paper_id)
        LEFT JOIN {_listed("rels", "id || ' ' || source || '>' || target || ' ' || type || ' ' || description || ' ' || source_entity_id || ' ' || target_entity_id", "chunk_no, pos")} r USING (paper_id)
        LEFT JOIN {_listed("findings", "type || ' ' || statement || ' ' || evidence", "pos")} f USING (paper_id)
        LEFT JOIN {_listed("items", "CASE WHEN l_discount > 0 THEN p_name ELSE '-' END || ' ' || p_type || ' ' || p_brand || ',' || ' '", "pos", "WHERE chunk_no = 1")} m USING (paper_id)
        LEFT JOIN {_listed("items", "p_brand || ' ' || p_type || ' ' || CASE WHEN l_linestatus = 'O' THEN 'training' ELSE '-' END", "pos", "WHERE chunk_no = 2")} d USING (paper_id)
        LEFT JOIN {_listed("kcards", "front || ' ' || back || ' ' || tag || ' ' || difficulty || ' 1.0 2.5 0'", "pos")} c USING (paper_id)
        LEFT JOIN {_listed("items", "'sec_' || ord || ' ' || p_name || ' ' || (chunk_no - 3) || ' ' || p_brand", "ord", "WHERE chunk_no IN (4, 5)")} s USING (paper_id)""",
    ),
)
def k7(t: Tables) -> DataFrame:
    """Every part of the documents, read back in the order it is stored in."""
    docs = D.parse_knowledge(D.assemble_documents(t.knowledge(keep=True), now(), "m"))
    text = lambda c: c.cast("string")

    def listed(path: str, name: str, of: Callable[[Column], list[Column]]) -> Column:
        lines = F.transform(f"knowledge.{path}", lambda x: F.concat_ws(" ", *of(x)))
        return F.array_join(lines, "|").alias(name)

    return docs.select(
        "paper_id", F.col("knowledge.metadata.title").alias("title"),
        listed("entities", "entities", lambda x: [
            x["id"], x["name"], x["type"], F.array_join(x["aliases"], ","), x["definition"], text(F.round(x["importance"] * 1000).cast("int")),
        ]),
        listed("relationships", "relationships", lambda x: [
            x["id"], F.concat(x["source"], F.lit(">"), x["target"]), x["type"], x["description"], x["source_entity_id"], x["target_entity_id"],
        ]),
        listed("findings", "findings", lambda x: [x["type"], x["statement"], x["evidence"]]),
        listed("methods", "methods", lambda x: [F.coalesce(x["name"], F.lit("-")), x["description"], F.array_join(x["inputs"], ",")]),
        listed("datasets", "datasets", lambda x: [x["name"], x["description"], F.coalesce(x["usage"], F.lit("-"))]),
        listed("flashcards", "cards", lambda x: [
            x["front"], x["back"], F.array_join(x["tags"], ","), text(x["difficulty"]), text(x["srs"]["interval_days"]),
            text(x["srs"]["ease_factor"]), text(x["srs"]["repetitions"]),
        ]),
        listed("structure.sections", "sections", lambda x: [x["id"], x["title"], text(x["level"]), x["summary"]]),
    )


@query(
    "k8_paper_index",
    sql(
        "papers",
        """SELECT paper_id, CASE WHEN extraction_error IS NULL THEN title ELSE '' END AS title,
        CASE WHEN extraction_error IS NULL THEN coalesce(doi, '') ELSE '' END AS doi,
        CASE WHEN extraction_error IS NULL THEN year ELSE -1 END AS year,
        CASE WHEN extraction_error IS NULL THEN 'completed' ELSE 'error' END AS extraction_status,
        coalesce(extraction_error, '') AS extraction_error, CAST(o_orderkey % 2 AS BIGINT) AS failed_calls FROM papers""",
    ),
)
def k8(t: Tables) -> DataFrame:
    papers = t.papers()
    failed = t.read("orders").filter("o_orderkey % 2 = 1").select(F.concat(F.lit("pk_"), F.col("o_orderkey").cast("string")).alias("paper_id"))
    errors = papers.filter("extraction_error is not null").select("paper_id", F.col("extraction_error").alias("message"))
    return K.paper_index(papers.select("paper_id", "metadata"), failed, errors).select(
        "paper_id", "title", E.text_or_empty("doi").alias("doi"), F.coalesce("year", F.lit(-1)).alias("year"),
        "extraction_status", E.text_or_empty("extraction_error").alias("extraction_error"),
        F.col("failed_calls").cast("bigint").alias("failed_calls"),
    )


@query(
    "k9_global_entities",
    sql("firsts", "SELECT user_id, entity_key, name, type, definition, round(importance, 6) AS importance, id, paper_id FROM firsts"),
)
def k9(t: Tables) -> DataFrame:
    return K.global_entities(t.entities(), t.papers()).select(
        "user_id", "entity_key", "name", "type", "definition", r6("importance"), "id", "paper_id"
    )


@query(
    "k10_entity_papers",
    sql(
        "global_",
        """SELECT user_id, entity_key, first_value(name) OVER w AS name, first_value(type) OVER w AS type, title, paper_id,
        first_chunk, first_pos FROM global_
        WINDOW w AS (PARTITION BY user_id, entity_key ORDER BY created_at, paper_id, first_chunk, first_pos)""",
    ),
)
def k10(t: Tables) -> DataFrame:
    return K.entity_papers(t.entities(), t.papers()).select(
        "user_id", "entity_key", "name", "type", "title", "paper_id", "first_chunk", "first_pos"
    )


def _merged(t: Tables) -> str:
    """A dictionary that half of the papers were merged into after the other half, and some of them twice."""
    path = new_path(t.spark, "dictionary")
    entities, papers = t.entities(), t.papers()  # still dealt by paper, and only what a part needs is made
    number = F.substring("paper_id", 4, 20).cast("bigint")
    for part in (number % 2 == 1, (number % 2 == 0) | (number % 9 == 1)):
        merge_papers(entities.filter(part), papers, path, buckets=32)
    return path


@query(
    "k9_merged_entities",
    sql("firsts", "SELECT user_id, entity_key, name, type, definition, round(importance, 6) AS importance, id, paper_id FROM firsts"),
)
def k9_merged(t: Tables) -> DataFrame:
    return dictionary(t.spark, _merged(t)).select(
        "user_id", "entity_key", "name", "type", "definition", r6("importance"), "id", "paper_id"
    )


@query(
    "k10_merged_papers",
    sql(
        "global_",
        """SELECT user_id, entity_key, first_value(name) OVER w AS name, first_value(type) OVER w AS type, title, paper_id,
        first_chunk, first_pos FROM global_
        WINDOW w AS (PARTITION BY user_id, entity_key ORDER BY created_at, paper_id, first_chunk, first_pos)""",
    ),
)
def k10_merged(t: Tables) -> DataFrame:
    return papers_of_entities(t.spark, _merged(t)).select(
        "user_id", "entity_key", "name", "type", "title", "paper_id", "first_chunk", "first_pos"
    )


def _mapping(t: Tables) -> DataFrame:
    """Mapping rows of an earlier run: the notes of even papers, and an entity named like a user for some."""
    papers = t.papers().filter(F.substring("paper_id", 4, 20).cast("bigint") % 2 == 0)
    paper_rows = papers.select(
        "user_id", "paper_id", F.lit("paper").alias("item_type"), F.col("paper_id").alias("item_id"),
        F.col("paper_id").alias("normalized_key"),
        F.concat(F.lit("Papers/Old "), F.col("paper_id"), F.lit(".md")).alias("relative_path"),
    )
    entity_rows = papers.select(
        "user_id", "paper_id", F.lit("entity").alias("item_type"), F.lit("hot rod").alias("item_id"),
        F.lit("hot rod").alias("normalized_key"), F.lit("Entities/hot rod.md").alias("relative_path"),
    )
    return paper_rows.unionByName(entity_rows)


@query(
    "k11_entity_paper_links",
    sql(
        "ents papers",
        f"""SELECT user_id, k AS entity_key, paper_id, title, CASE WHEN o_orderkey % 2 = 0 THEN 'Old ' || paper_id ELSE {_sanitize('title')} END AS target
        FROM (SELECT paper_id, {_squeeze('lower(name)')} AS k FROM ents UNION
              SELECT paper_id, 'hot rod' FROM papers WHERE o_orderkey % 2 = 0) JOIN papers USING (paper_id)""",
    ),
)
def k11(t: Tables) -> DataFrame:
    return K.entity_paper_links(_mapping(t), t.entities(), t.papers())


@query(
    "k12_incident_relations",
    sql(
        "rels",
        """SELECT lower(source) AS entity_key, id, source, target FROM rels
        UNION ALL SELECT lower(target), id, source, target FROM rels WHERE lower(source) <> lower(target)""",
    ),
)
def k12(t: Tables) -> DataFrame:
    return K.incident_relations(t.relations()).select("entity_key", "id", "source", "target")


@query(
    "k13_note_entities",
    sql(
        "ents papers",
        f""", d AS (SELECT paper_id, chunk_no, pos, trim(name) AS name, upper(type) AS type, coalesce(definition, '') AS definition
          FROM mentions SEMI JOIN (SELECT paper_id FROM papers WHERE o_orderkey % 3 = 0) USING (paper_id) WHERE l_keep),
        i AS (SELECT paper_id, first_chunk AS chunk_no, first_pos AS pos, name, type, coalesce(definition, '') AS definition FROM ents
          ANTI JOIN d USING (paper_id))
        SELECT user_id, paper_id, {_squeeze('lower(name)')} AS entity_key, name, type, definition
        FROM (FROM d UNION ALL FROM i) JOIN papers USING (paper_id)
        QUALIFY row_number() OVER (PARTITION BY paper_id, {_squeeze('lower(name)')} ORDER BY chunk_no, pos) = 1""".replace(
            "WHERE l_keep", "WHERE chunk_no <> 1"
        ),
    ),
)
def k13(t: Tables) -> DataFrame:
    """Documents of every third paper list their entities under the alternative spelling; the rest use the index."""
    third = t.papers().filter(F.substring("paper_id", 4, 20).cast("bigint") % 3 == 0).select("paper_id")
    document = t.mentions().filter("chunk_no <> 1").join(third, "paper_id", "left_semi").select(
        "paper_id", "chunk_no", "pos", "name", F.lit("").alias("type"), F.upper("type").alias("entity_type"),
        F.lit(None).cast("string").alias("definition"), F.col("definition").alias("description"),
    )
    return K.note_entities(t.papers(), document, t.entities()).select(
        "user_id", "paper_id", "entity_key", "name", "type", "definition"
    )


# ---- highlights -----------------------------------------------------------------------------------------------


def _applied(t: Tables) -> DataFrame:
    return H.apply_selections(T.sentences(t.documents()), _selections(t))


@query(
    "h1_apply_selections",
    sql("applied", "SELECT doc_id, sentence_id, category, coalesce(text, '') AS text, matched FROM applied"),
)
def h1(t: Tables) -> DataFrame:
    return _applied(t).select("doc_id", "sentence_id", "category", E.text_or_empty("text").alias("text"), "matched")


@query("h2_highlight_stats", sql("stats", "SELECT * FROM stats"))
def h2(t: Tables) -> DataFrame:
    return H.highlight_stats(_applied(t))


@query(
    "h3_highlight_status",
    sql(
        "stats",
        """SELECT doc_id, CASE WHEN total > 0 AND failed_matches = 0 THEN 'success' WHEN total > 0 THEN 'partial'
        ELSE 'failed' END AS status FROM stats""",
    ),
)
def h3(t: Tables) -> DataFrame:
    return H.highlight_status(H.highlight_stats(_applied(t))).select("doc_id", "status")


@query(
    "h4_filter_highlights",
    sql("applied", "SELECT doc_id, sentence_id, text FROM applied WHERE matched AND category = 'key_data'"),
)
def h4(t: Tables) -> DataFrame:
    return H.filter_highlights(_applied(t), "key_data").select("doc_id", "sentence_id", "text")


# ---- queries --------------------------------------------------------------------------------------------------


@query(
    "q1_list_papers",
    sql(
        "papers",
        f"""SELECT user_id, paper_id, task_id, title, coalesce(doi, '') AS doi, year, venue, extraction_status,
        strftime(created_at, {STAMP}) AS created_at FROM papers""",
    ),
)
def q1(t: Tables) -> DataFrame:
    return Q.list_papers(t.papers()).select(
        "user_id", "paper_id", "task_id", "title", E.text_or_empty("doi").alias("doi"), "year", "venue",
        "extraction_status", stamp("created_at"),
    )


@query(
    "q1_extraction_status",
    sql("papers", "SELECT paper_id, extraction_status, coalesce(extraction_error, '') AS extraction_error, title FROM papers"),
)
def q1_status(t: Tables) -> DataFrame:
    return Q.extraction_status(t.papers()).select(
        "paper_id", "extraction_status", E.text_or_empty("extraction_error").alias("extraction_error"), "title"
    )


@query(
    "q2_paper_view",
    sql(
        "papers live annots",
        f"""SELECT paper_id, user_id, 'paper' AS part, paper_id AS item_id, title AS body, '' AS extra, extraction_status AS state FROM papers
        UNION ALL SELECT l.paper_id, l.user_id, 'card', card_id, front, back, '0' FROM live l JOIN papers p ON l.paper_id = p.paper_id AND l.user_id = p.user_id WHERE has_document
        UNION ALL SELECT a.paper_id, a.user_id, 'annotation', annotation_id, content, type, strftime(a.created_at, {STAMP})
        FROM annots a JOIN papers p ON a.paper_id = p.paper_id AND a.user_id = p.user_id WHERE has_document""",
    ),
)
def q2(t: Tables) -> DataFrame:
    view = Q.paper_view(t.papers(), t.live_cards(), t.annotations())
    return view.withColumn("extra", E.text_or_empty("extra"))


@query(
    "q3_graph_nodes",
    sql("ents papers", "SELECT user_id, id, name, type, definition, round(importance, 6) AS importance, paper_id FROM ents JOIN papers USING (paper_id)"),
)
def q3_nodes(t: Tables) -> DataFrame:
    return Q.graph_nodes(K.with_paper(t.entities(), t.papers(), "user_id")).withColumn("importance", r6("importance"))


@query(
    "q3_graph_edges",
    sql(
        "rels papers",
        """SELECT user_id, id, source_entity_id AS source, target_entity_id AS target, type, description,
        round(confidence, 6) AS confidence FROM rels JOIN papers USING (paper_id)""",
    ),
)
def q3_edges(t: Tables) -> DataFrame:
    return Q.graph_edges(K.with_paper(t.relations(), t.papers(), "user_id")).withColumn("confidence", r6("confidence"))


@query(
    "q4_search_entities",
    sql("ents", "SELECT id, name, type, definition, paper_id FROM ents WHERE contains(lower(name), 'hot')"),
)
def q4(t: Tables) -> DataFrame:
    return Q.search_entities(t.entities(), "HOT")


@query(
    "q5_list_cards",
    sql(
        "cards",
        """SELECT card_id, user_id, CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN '' ELSE event_type || '|b' END AS tags FROM cards""",
    ),
)
def q5(t: Tables) -> DataFrame:
    # One event type has null tags, one malformed JSON.
    tags = F.when(F.col("event_type") == "view", F.lit("[1,")).when(
        F.col("event_type") != "error", F.to_json(F.array("event_type", F.lit("b")))
    )
    return Q.list_cards(t.cards().withColumn("tags_json", tags)).select("card_id", "user_id", F.array_join("tags", "|").alias("tags"))


@query(
    "q6_due_cards",
    sql(
        "state",
        f"""SELECT user_id, card_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY next_review, card_id) AS rank
        FROM state WHERE next_review <= TIMESTAMP '{NOW}') WHERE rank <= 20""",
    ),
)
def q6(t: Tables) -> DataFrame:
    return R.due_cards(_state(t), now()).select("user_id", "card_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "q7_due_count",
    sql("state", f"SELECT user_id, count(*) FILTER (next_review <= TIMESTAMP '{NOW}') AS due FROM state GROUP BY user_id"),
)
def q7(t: Tables) -> DataFrame:
    return R.due_count(_state(t), now())


@query(
    "q8_list_annotations",
    sql("annots", f"SELECT annotation_id, paper_id, user_id, type, content, strftime(created_at, {STAMP}) AS created_at FROM annots"),
)
def q8(t: Tables) -> DataFrame:
    return Q.list_annotations(t.annotations()).withColumn("created_at", stamp("created_at"))


@query(
    "q9_list_tasks",
    sql(
        "tasks",
        """SELECT user_id, task_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, task_id) AS rank
        FROM tasks) WHERE rank <= 50""",
    ),
)
def q9(t: Tables) -> DataFrame:
    return Q.list_tasks(t.tasks()).select("user_id", "task_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "q4_search_entities_indexed",
    sql(
        "ents",
        """SELECT q AS fragment, id, name, paper_id FROM ents, unnest(['hot', 'm', 'e ', 'lamp', 'no such name', 'D P']) AS u(q)
        WHERE contains(lower(name), lower(q))""",
    ),
)
def q4_indexed(t: Tables) -> DataFrame:
    """Searches of several lengths through one index of the entities' names."""
    index = TextIndex(t.spark, new_path(t.spark, "names"), "name")
    index.build(t.entities().select("id", "name", "paper_id"))
    found = [index.search(q).select(F.lit(q).alias("fragment"), "id", "name", "paper_id") for q in ("hot", "m", "e ", "lamp", "no such name", "D P")]
    return reduce(DataFrame.unionByName, found)


@query("q10_search_titles_indexed", sql("papers", "SELECT paper_id, title FROM papers WHERE contains(lower(title), 'high/1')"))
def q10_indexed(t: Tables) -> DataFrame:
    index = TextIndex(t.spark, new_path(t.spark, "titles"), "title")
    index.build(t.papers().select("paper_id", "title"))
    return index.search("High/1")


@query("q10_search_titles", sql("papers", "SELECT paper_id, title FROM papers WHERE contains(lower(title), 'high/1')"))
def q10(t: Tables) -> DataFrame:
    return Q.search(t.papers(), "title", "High/1").select("paper_id", "title")


@query(
    "q11_neighbours",
    sql(
        "rels ents",
        """, sides AS (SELECT id AS edge_id, type, 'out' AS direction, source_entity_id AS node, target_entity_id AS other FROM rels
          UNION ALL SELECT id, type, 'in', target_entity_id, source_entity_id FROM rels WHERE source_entity_id <> target_entity_id),
        n AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY edge_id) AS rank FROM sides)
        SELECT node AS node_id, rank, direction, n.type, edge_id, coalesce(ents.name, '?') AS other_name
        FROM n LEFT JOIN ents ON ents.id = other WHERE rank <= 5""",
    ),
)
def q11(t: Tables) -> DataFrame:
    return Q.neighbours(t.entities(), t.relations()).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "q12_summary_keywords",
    "SELECT doc_id AS paper_id, unnest([lang, source]) AS text, unnest([CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS importance FROM documents",
)
def q12(t: Tables) -> DataFrame:
    word = lambda c, w: F.struct(F.col(c).alias("text"), F.lit("concept").alias("type"), F.lit(w).alias("importance"))
    summaries = t.read("documents").select(
        F.col("doc_id").alias("paper_id"), F.struct(F.array(word("lang", 0.5), word("source", 0.9)).alias("keywords")).alias("summary")
    )
    return Q.summary_keywords(summaries).select("paper_id", "text", "importance")


@query(
    "q13_paper_counts",
    sql(
        "done ents findings kcards rels",
        """SELECT paper_id, coalesce(e, 0) AS entities, coalesce(f, 0) AS findings, coalesce(c, 0) AS cards, coalesce(r, 0) AS relationships FROM done
        LEFT JOIN (SELECT paper_id, count(*) AS e FROM ents GROUP BY 1) USING (paper_id)
        LEFT JOIN (SELECT paper_id, count(*) AS f FROM findings GROUP BY 1) USING (paper_id)
        LEFT JOIN (SELECT paper_id, count(*) AS c FROM kcards GROUP BY 1) USING (paper_id)
        LEFT JOIN (SELECT paper_id, count(*) AS r FROM rels GROUP BY 1) USING (paper_id)""",
    ),
)
def q13(t: Tables) -> DataFrame:
    kb = t.knowledge(keep=True)
    return Q.paper_counts(kb.papers, kb.entities, kb.findings, kb.cards, kb.relations)


@query("q14_completed_papers", sql("done", "SELECT paper_id, user_id, title FROM done"))
def q14(t: Tables) -> DataFrame:
    return Q.completed_papers(t.papers()).select("paper_id", "user_id", "title")


# ---- spaced repetition ----------------------------------------------------------------------------------------


def _state(t: Tables) -> DataFrame:
    return R.review_state(t.cards(), t.reviews())


@query(
    "r1_review_state",
    sql(
        "state",
        f"""SELECT card_id, reps AS repetitions, round(iv, 6) AS interval_days, round(ease, 6) AS ease_factor,
        strftime(last_review, {STAMP}) AS last_review, strftime(next_review, {STAMP}) AS next_review FROM state""",
    ),
)
def r1(t: Tables) -> DataFrame:
    return _state(t).select(
        "card_id", "repetitions", r6("interval_days"), r6("ease_factor"), stamp("last_review"), stamp("next_review")
    )


_FOLD_START = """SELECT DISTINCT card_id, 0 AS n, CAST(u % 4 AS INTEGER) AS reps, CAST(u % 5 + 1 AS DOUBLE) AS iv,
      CAST(1.3 AS DOUBLE) + (u % 4) * CAST(0.5 AS DOUBLE) AS ease, CAST(NULL AS TIMESTAMP) AS ts FROM
      (SELECT user_id || ':' || event_type AS card_id, user_id AS u FROM events)"""


@query(
    "r2_review_stream",
    f"""WITH RECURSIVE log AS (SELECT user_id || ':' || event_type AS card_id, ts, CAST(event_id % 7 - 1 AS INTEGER) AS q,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_id % 7 BETWEEN 1 AND 6),
    folded AS ({_FOLD_START} UNION ALL
      SELECT f.card_id, f.n + 1, CASE WHEN l.q >= 3 THEN f.reps + 1 ELSE 0 END,
        CASE WHEN l.q < 3 THEN 1.0 WHEN f.reps = 0 THEN 1.0 WHEN f.reps = 1 THEN 6.0 ELSE f.iv * f.ease END,
        greatest(CAST(1.3 AS DOUBLE), f.ease + CAST(0.1 AS DOUBLE) - (5 - l.q) * (CAST(0.08 AS DOUBLE) + (5 - l.q) * CAST(0.02 AS DOUBLE))),
        l.ts FROM folded f JOIN log l ON l.card_id = f.card_id AND l.n = f.n + 1)
    SELECT card_id, reps AS repetitions, round(iv, 6) AS interval_days, round(ease, 6) AS ease_factor,
      strftime(ts, {STAMP}) AS last_review FROM folded WHERE n > 0
    QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY n DESC) = 1""",
)
def r2(t: Tables) -> DataFrame:
    """Reviews in several triggers whose times overlap, on cards that have a state, give the state of the batch."""
    return apply_reviews(t.review_stream(), t.started_cards(), "3650 days").select(
        "card_id", "repetitions", r6("interval_days"), r6("ease_factor"), stamp("last_review")
    )


@query(
    "r3_valid_reviews",
    """SELECT event_id AS review_id, CASE WHEN event_id % 7 = 0 OR event_id % 7 - 1 > 5 THEN 'bad_quality' WHEN event_type = 'signup' THEN 'not_found'
    WHEN event_id % 11 = 0 THEN 'forbidden' ELSE '' END AS reason FROM events""",
)
def r3(t: Tables) -> DataFrame:
    known = t.cards().filter("event_type <> 'signup'")
    sent = t.reviews().withColumn("quality", (F.col("review_id") % 7 - 1).cast("int")).withColumn(
        "user_id", F.when(F.col("review_id") % 11 == 0, -1).otherwise(F.col("user_id"))
    )
    return R.valid_reviews(sent, known).select("review_id", E.text_or_empty("reason").alias("reason"))


@query(
    "r4_accept_cards",
    sql(
        "papers",
        f"""SELECT p.paper_id, p.user_id, front, tags, {_id('fc', 'p.paper_id', 'CAST(p.user_id AS VARCHAR)', 'front', "'b'")} AS card_id FROM (
        SELECT 'pk_' || l_orderkey AS paper_id, l_suppkey AS user_id, l_returnflag AS front, l_linestatus || '|z' AS tags FROM lineitem) n
        JOIN papers p ON p.paper_id = n.paper_id AND p.user_id = n.user_id""",
    ),
)
def r4(t: Tables) -> DataFrame:
    new = t.read("lineitem").select(
        F.concat(F.lit("pk_"), F.col("l_orderkey").cast("string")).alias("paper_id"), F.col("l_suppkey").alias("user_id"),
        F.col("l_returnflag").alias("front"), F.lit("b").alias("back"),
        F.concat(F.lit(" "), "l_linestatus", F.lit(", ,z")).alias("tags"), F.lit(None).cast("int").alias("difficulty"),
    )
    return R.accept_cards(new, t.papers(), now()).select(
        "paper_id", "user_id", "front", F.array_join("tags", "|").alias("tags"), "card_id"
    )


@query(
    "r4_accept_annotations",
    sql(
        "annots papers",
        f"""SELECT {_id('ann', 'a.paper_id', 'CAST(a.user_id AS VARCHAR)', "strftime(a.created_at, '%Y-%m-%d %H:%M:%S')", 'content')} AS annotation_id,
          a.paper_id, a.user_id, content, type || '|x' AS tags FROM annots a JOIN papers p ON p.paper_id = a.paper_id AND p.user_id = a.user_id""",
    ),
)
def r4_annotations(t: Tables) -> DataFrame:
    sent = t.annotations().drop("annotation_id").withColumn("tags", F.concat(F.lit(" "), "type", F.lit(" ,, x")))
    return R.accept_annotations(sent, t.papers()).select(
        "annotation_id", "paper_id", "user_id", "content", F.array_join("tags", "|").alias("tags")
    )


# ---- lifecycle ------------------------------------------------------------------------------------------------


@query(
    "m1_plan_extraction",
    sql(
        "papers",
        """SELECT task_id, CASE WHEN o_orderkey % 4 = 0 THEN 'start_new' WHEN extraction_status = 'extracting' THEN 'skip_running'
        WHEN extraction_status = 'completed' THEN 'skip_completed' ELSE 'restart' END AS action FROM papers WHERE o_orderkey % 5 <> 0""",
    ),
)
def m1(t: Tables) -> DataFrame:
    number = F.substring("paper_id", 4, 20).cast("bigint")
    tasks = t.papers().select("task_id", "user_id", F.when(number % 5 == 0, "rewriting").otherwise("completed").alias("status"))
    return M.plan_extraction(tasks, t.papers().filter(number % 4 != 0)).select("task_id", "action")


@query(
    "m1_claim_papers",
    sql(
        "papers",
        """SELECT * FROM (WITH p AS (SELECT *, o_orderkey % 5 <> 0 AS finished, o_orderkey % 4 <> 0 AS known FROM papers),
        q AS (SELECT *, known AND finished AND extraction_status NOT IN ('extracting', 'completed') AS again FROM p)
        SELECT CASE WHEN known THEN paper_id ELSE 'pk_' || substr(sha256(task_id), 1, 24) END AS paper_id, task_id,
          CASE WHEN again OR NOT known THEN 'extracting' ELSE extraction_status END AS extraction_status,
          CASE WHEN known AND NOT again THEN coalesce(extraction_error, '') ELSE '' END AS extraction_error,
          CASE WHEN again OR NOT known THEN 'm2' ELSE 'm1' END AS extraction_model FROM q WHERE known OR finished)""",
    ),
)
def m1_claims(t: Tables) -> DataFrame:
    """The paper table after the claims: restarted papers without their error, new ones appended, all others as they were."""
    number = F.substring("paper_id", 4, 20).cast("bigint")
    tasks = t.papers().select("task_id", "user_id", F.when(number % 5 == 0, "rewriting").otherwise("completed").alias("status"))
    known = t.papers().filter(number % 4 != 0).withColumns({"extraction_model": F.lit("m1"), "updated_at": now("2024-01-01 00:00:00")})
    claimed = M.claim_papers(known, M.plan_extraction(tasks, known), "m2", now())
    return claimed.select("paper_id", "task_id", "extraction_status", E.text_or_empty("extraction_error").alias("extraction_error"), "extraction_model")


@query(
    "m2_expired",
    sql("tasks", f"SELECT task_id FROM tasks WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 20000 MINUTE AND status IN ('completed', 'error')"),
)
def m2(t: Tables) -> DataFrame:
    return M.expired(t.tasks(), now(), 20_000).select("task_id")


@query(
    "m2_expired_drafts",
    sql("tasks", f"SELECT task_id FROM tasks WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 20000 MINUTE"),
)
def m2_drafts(t: Tables) -> DataFrame:
    return M.expired(t.tasks(), now(), 20_000, states=None).select("task_id")


@query(
    "m3_reconcile_orphans",
    sql(
        "tasks",
        f"""SELECT task_id, CASE WHEN status = 'completed' THEN status ELSE 'error' END AS status,
        CASE WHEN status IN ('completed', 'error') THEN '' ELSE '{ORPHAN_MESSAGE}' END AS message FROM tasks""",
    ),
)
def m3(t: Tables) -> DataFrame:
    return M.reconcile_orphans(t.tasks()).select("task_id", "status", "message")


@query(
    "m4_delete_papers",
    sql(
        "ents rels annots papers live",
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, {key} AS id FROM {table} WHERE CAST(substr(paper_id, 4) AS BIGINT) % 3 <> 0"
            for kind, key, table in (
                ("papers", "paper_id", "papers"), ("entities", "id", "ents"), ("relations", "id", "rels"),
                ("annotations", "annotation_id", "annots"), ("cards", "card_id", "live"),
            )
        )
        + " UNION ALL SELECT 'notes', 'obs_' || substr(sha1(user_id || ':' || paper_id || ':paper:' || paper_id || ':/vault'), 1, 24) "
        "FROM papers WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0",
    ),
)
def m4(t: Tables) -> DataFrame:
    """A paper goes with its entities, relations, annotations, cards and the mapping of its notes."""
    gone = t.papers().filter(F.substring("paper_id", 4, 20).cast("bigint") % 3 == 0).select("paper_id")
    left = M.delete_papers(
        {
            "papers": t.papers().withColumn("id", F.col("paper_id")),
            "entities": t.entities(),
            "relations": t.relations(),
            "annotations": t.annotations().withColumnRenamed("annotation_id", "id"),
            "cards": t.live_cards().withColumnRenamed("card_id", "id"),
            "notes": _notes(t)[1].withColumnRenamed("mapping_id", "id"),
        },
        gone,
    )
    rows = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in left.items()]
    return reduce(DataFrame.unionByName, rows)


_LATEST = """SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'parsing'
    WHEN 'click' THEN 'rewriting' WHEN 'purchase' THEN 'completed' ELSE 'error' END AS status, CAST(floor(value) AS BIGINT) % 101 AS percent
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


@query(
    "m5_latest_state",
    _LATEST,
)
def m5(t: Tables) -> DataFrame:
    return M.latest_state(t.progress()).select("task_id", "seq", "status", "percent")


@query("m5_latest_state_stream", _LATEST)
def m5_stream(t: Tables) -> DataFrame:
    return latest_rows(latest_state_stream(t.progress(t.event_stream()), "3650 days"), "task_id").rows.select("task_id", "seq", "status", "percent")


def _notes(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes of all papers, the mapping an earlier run left (every fourth hash is stale), and the files present."""
    vault = F.lit("/vault")
    path = F.concat(F.lit("Papers/"), X.sanitize_name(F.col("title")), F.lit(".md"))
    notes = t.papers().select(
        M.mapping_id(F.col("user_id"), F.col("paper_id"), F.lit("paper"), F.col("paper_id"), vault).alias("mapping_id"),
        "user_id", "paper_id", F.lit("paper").alias("item_type"), F.col("paper_id").alias("item_id"),
        F.col("paper_id").alias("normalized_key"), F.col("title").alias("source_name"), vault.alias("vault_path"),
        path.alias("relative_path"), F.sha2("title", 256).alias("content_hash"),
    )
    number = F.substring("paper_id", 4, 20).cast("bigint")
    stale = F.when(number % 4 == 0, F.lit("stale")).otherwise(F.col("content_hash"))
    mapping = notes.filter(number % 2 == 0).withColumns(
        {"content_hash": stale, "updated_at": now("2024-01-01 00:00:00")}
    )
    return notes.filter(number % 5 != 0), mapping, notes.filter(number % 3 != 0).select("vault_path", "relative_path")


_MAP_ID = "'obs_' || substr(sha1(user_id || ':' || paper_id || ':paper:' || paper_id || ':/vault'), 1, 24)"


@query(
    "m6_plan_notes",
    sql(
        "papers",
        f"""SELECT {_MAP_ID} AS mapping_id, 'Papers/' || {_sanitize('title')} || '.md' AS relative_path,
        CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 = 0 THEN 'stale' ELSE sha256(title) END AS content_hash,
        CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 THEN 'skipped'
          ELSE 'written' END AS state FROM papers WHERE o_orderkey % 5 <> 0 OR o_orderkey % 2 = 0""",
    ),
)
def m6(t: Tables) -> DataFrame:
    return M.plan_notes(*_notes(t), now()).select(
        "mapping_id", "relative_path", "content_hash", E.text_or_empty("state").alias("state")
    )


@query(
    "m6_upsert_mapping",
    sql(
        "papers",
        f"""SELECT {_MAP_ID} AS mapping_id, 'Papers/' || {_sanitize('title')} || '.md' AS relative_path,
        CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 = 0 THEN 'stale' ELSE sha256(title) END AS content_hash
        FROM papers WHERE o_orderkey % 5 <> 0 OR o_orderkey % 2 = 0""",
    ),
)
def m6_upsert(t: Tables) -> DataFrame:
    """The mapping table after a run, read back: made by an earlier run, then overwritten where this one has notes."""
    notes, mapping, inventory = _notes(t)
    path = new_path(t.spark, "mapping")
    upsert_notes(mapping.drop("updated_at"), path, inventory.limit(0), now("2024-01-01 00:00:00"), buckets=32)
    upsert_notes(notes, path, inventory, now(), buckets=32)
    return read_mapping(t.spark, path).select("mapping_id", "relative_path", "content_hash")


@query(
    "m6_note_counts",
    sql(
        "papers",
        """SELECT count(*) FILTER (NOT s) AS files_written, count(*) FILTER (s) AS files_skipped FROM (
        SELECT o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 AS s FROM papers WHERE o_orderkey % 5 <> 0)""",
    ),
)
def m6_counts(t: Tables) -> DataFrame:
    return M.note_counts(M.plan_notes(*_notes(t), now()))


@query(
    "m7_resolve_paths",
    sql(
        "papers",
        f""", i AS (SELECT paper_id AS item_id, 'Root/Papers/' || {_sanitize('venue')} AS base, substr(sha1('paper:' || paper_id || ':' || title), 1, 3) AS suffix,
          CASE WHEN o_orderkey % 12 = 0 THEN 'Root/Papers/Mapped ' || paper_id || '.md' WHEN o_orderkey % 4 = 0 THEN 'Moved/' || paper_id || '.md' END AS settled FROM papers),
        w AS (SELECT base, min(item_id) AS first_id FROM i WHERE settled IS NULL GROUP BY base),
        r AS (SELECT item_id, base || '-' || suffix AS stem, row_number() OVER (PARTITION BY base, suffix ORDER BY item_id) AS n
          FROM i JOIN w USING (base) WHERE settled IS NULL AND item_id <> first_id),
        t AS (SELECT DISTINCT base || '-' || suffix AS stem, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [1] ELSE [2, 3] END) AS used
          FROM i JOIN papers ON paper_id = item_id WHERE o_orderkey % 4 = 1),
        -- The free numbers of a stem in order.
        f AS (SELECT x.stem, k, row_number() OVER (PARTITION BY x.stem ORDER BY k) AS n
          FROM (SELECT stem, unnest(range(1, max(n) + 4)) AS k FROM r GROUP BY stem) x ANTI JOIN t ON t.stem = x.stem AND t.used = x.k)
        SELECT item_id, settled AS relative_path FROM i WHERE settled IS NOT NULL UNION ALL SELECT first_id, base || '.md' FROM w
        UNION ALL SELECT item_id, stem || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.md' FROM r JOIN f USING (stem, n)""",
    ),
)
def m7(t: Tables) -> DataFrame:
    """Notes named by venue only, so that very many want the same name."""
    papers, vault = t.papers(), F.lit("/vault")
    items = papers.select(
        vault.alias("vault_path"), F.lit("paper").alias("item_type"), F.col("paper_id").alias("item_id"),
        F.col("paper_id").alias("normalized_key"), F.col("title").alias("source_name"), F.lit("Papers").alias("folder"),
        X.sanitize_name(F.col("venue")).alias("desired_name"),
        M.mapping_id(F.col("user_id"), F.col("paper_id"), F.lit("paper"), F.col("paper_id"), vault).alias("mapping_id"),
    )
    number = F.substring("item_id", 4, 20).cast("bigint")
    mapping = items.filter(number % 6 == 0).select(
        "mapping_id", F.concat(F.lit("Root/Papers/Mapped "), F.col("item_id"), F.lit(".md")).alias("relative_path")
    )
    inventory = items.filter(number % 4 == 0).select(
        "vault_path",
        F.when(number % 12 == 0, F.concat(F.lit("Root/Papers/Mapped "), F.col("item_id"), F.lit(".md")))
        .otherwise(F.concat(F.lit("Moved/"), F.col("item_id"), F.lit(".md"))).alias("relative_path"),
        F.lit("paper").alias("note_type"), F.col("item_id").alias("note_id"),
    )
    # Files of nobody that have some of the suffixed names already.
    suffix = F.substring(F.sha1(F.concat_ws(":", F.lit("paper"), "item_id", "source_name")), 1, 3)
    stem = F.concat(F.lit("Root/Papers/"), "desired_name", F.lit("-"), suffix)
    endings = F.when(number % 3 == 0, F.array(F.lit(".md"))).otherwise(F.array(F.lit("_2.md"), F.lit("_3.md")))
    strangers = items.filter(number % 4 == 1).select("vault_path", F.explode(F.transform(endings, lambda e: F.concat(stem, e))).alias("relative_path"))
    inventory = inventory.unionByName(strangers.distinct(), allowMissingColumns=True)
    return M.resolve_paths(items, mapping, inventory, root="Root").select("item_id", "relative_path")


# ---- links ----------------------------------------------------------------------------------------------------

_URI = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


_HOST = f"""rtrim(regexp_replace(regexp_extract(lower(regexp_replace(regexp_extract(%s, '{_URI}', 2), '^.*@', '')),
  '^(\\[[^\\]]*\\]|[^:]*)'), '[\\[\\]]', '', 'g'), '.')"""


def _digits(text: str, base: int) -> str:
    return (
        f"coalesce(list_reduce(list_transform(string_split({text}, ''), lambda c: instr('0123456789abcdef', c) - 1), "
        f"lambda a, b: a * {base} + b), 0)::BIGINT"
    )


@query(
    "u1_normalize_url",
    sql(
        "links",
        rf"""SELECT * FROM (WITH a AS (SELECT page_id, kind, CASE WHEN regexp_matches(trim(link), '^https?://') THEN trim(link)
          ELSE 'https://' || trim(link) END AS u FROM links),
        b AS (SELECT *, {_HOST % 'u'} AS h, regexp_extract(u, '{_URI}', 3) AS p FROM a)
        SELECT page_id, kind, CASE
          WHEN h IN ('arxiv.org', 'www.arxiv.org') AND (regexp_matches(p, '^/abs/.') OR regexp_matches(p, '^/pdf/.') AND NOT suffix(p, '.pdf'))
            THEN 'https://arxiv.org/pdf/' || regexp_replace(substr(p, 6), '(.)/$', '\1') || '.pdf'
          WHEN h IN ('github.com', 'www.github.com') AND regexp_matches(p, '^/[^/]+/[^/]+/blob/.')
            THEN 'https://raw.githubusercontent.com' || regexp_replace(p, '/blob/', '/')
          ELSE u END AS url FROM b)""",
    ),
)
def u1(t: Tables) -> DataFrame:
    return t.links().select("page_id", "kind", U.normalize_url(F.col("link")).alias("url"))


@query(
    "u2_screen_url",
    sql(
        "links",
        rf"""SELECT * FROM (WITH a AS (SELECT page_id, kind, {_HOST % 'link'} AS h, lower(regexp_extract(link, '{_URI}', 1)) AS s FROM links),
        b AS (SELECT *, string_split(h, '.') AS parts FROM a),
        c AS (SELECT *, list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^0x[0-9a-f]+$') THEN {_digits('substr(x, 3)', 16)}
          WHEN regexp_matches(x, '^0[0-7]*$') THEN {_digits('x', 8)}
          WHEN regexp_matches(x, '^[1-9][0-9]*$') THEN {_digits('x', 10)} END) AS v FROM b),
        d AS (SELECT *, CASE WHEN len(v) <= 4 AND len(list_filter(v, lambda x: x IS NULL)) = 0 THEN CASE len(v)
          WHEN 1 THEN v[1] WHEN 2 THEN v[1] * 16777216 + v[2] WHEN 3 THEN v[1] * 16777216 + v[2] * 65536 + v[3]
          ELSE v[1] * 16777216 + v[2] * 65536 + v[3] * 256 + v[4] END END AS n FROM c)
        SELECT page_id, kind, CASE WHEN s NOT IN ('http', 'https') THEN 'bad_scheme'
          WHEN h IN ('localhost', '127.0.0.1', '0.0.0.0', '::1', '') THEN 'blocked_host'
          WHEN suffix(h, '.local') OR suffix(h, '.internal') OR suffix(h, '.localhost') THEN 'private_network'
          WHEN n // 16777216 IN (0, 10) OR n // 1048576 = 2753 OR n // 65536 IN (49320, 43518) THEN 'private_network'
          WHEN n // 16777216 = 127 OR n // 256 IN (12582912, 12582914, 12989284, 13303921) OR n // 131072 = 25353
            OR n // 4194304 = 401 OR n >= 3758096384 THEN 'non_public_address'
          WHEN contains(h, ':') AND NOT regexp_matches(h, '^[23]') THEN 'non_public_address' ELSE '' END AS reason FROM d)""",
    ),
)
def u2(t: Tables) -> DataFrame:
    return t.links().select("page_id", "kind", E.text_or_empty(U.screen_url(F.col("link"))).alias("reason"))


@query(
    "u3_accept_content",
    sql(
        "links",
        rf"""SELECT page_id, kind, page_id % 2 = 0 OR {_HOST % 'link'} IN ('arxiv.org', 'www.arxiv.org', 'export.arxiv.org',
        'openreview.net', 'proceedings.neurips.cc', 'aclanthology.org', 'dl.acm.org', 'ieeexplore.ieee.org', 'link.springer.com',
        'www.biorxiv.org', 'www.medrxiv.org', 'github.com', 'raw.githubusercontent.com') AS accepted FROM links""",
    ),
)
def u3(t: Tables) -> DataFrame:
    kind = F.when(F.col("page_id") % 2 == 0, " Application/PDF ; charset=x").otherwise("text/html")
    return t.links().select("page_id", "kind", U.accepts_content_type(kind, F.col("link")).alias("accepted"))


@query(
    "u4_url_filename",
    sql(
        "links",
        f"""SELECT page_id, kind, CASE WHEN page_id % 3 = 0 THEN 'My ' || page_id || '.PDF' WHEN seg = '' THEN 'downloaded_paper.pdf'
        WHEN contains(seg, '.') THEN seg ELSE seg || '.pdf' END AS name FROM
        (SELECT page_id, kind, regexp_extract(rtrim(regexp_extract(link, '{_URI}', 3), '/'), '[^/]*$') AS seg FROM links)""",
    ),
)
def u4(t: Tables) -> DataFrame:
    given = F.concat(F.lit('attachment; filename="My '), F.col("page_id").cast("string"), F.lit('.PDF"'))
    header = F.when(F.col("page_id") % 3 == 0, given).when(F.col("page_id") % 3 == 1, "attachment; filename=x.html")
    return t.links().select("page_id", "kind", U.url_filename(F.col("link"), header).alias("name"))


# ---- exports --------------------------------------------------------------------------------------------------


@query(
    "e1_export_entities",
    sql("ents done", "SELECT id, name, type, definition, round(importance, 6) AS importance, title AS paper_title FROM ents JOIN done USING (paper_id)"),
)
def e1(t: Tables) -> DataFrame:
    return E.export_entities(t.knowledge()).withColumn("importance", r6("importance"))


@query(
    "e2_export_relations",
    sql(
        "rels done ents",
        """SELECT r.id, s.name AS source, g.name AS target, r.type, r.description, round(r.confidence, 6) AS confidence, title AS paper_title
        FROM rels r JOIN done USING (paper_id) LEFT JOIN ents s ON s.id = r.source_entity_id LEFT JOIN ents g ON g.id = r.target_entity_id""",
    ),
)
def e2(t: Tables) -> DataFrame:
    return E.export_relations(t.knowledge()).withColumn("confidence", r6("confidence"))


_NL = "chr(10)"


@query(
    "e3_bibtex",
    sql(
        "done",
        f"""SELECT paper_id, coalesce(bibtex, concat_ws({_NL}, '@article{{' || o_orderkey || ',', '  title = {{' || {_bib('title')} || '}},',
        '  author = {{' || {_bib("array_to_string(authors, ' and ')")} || '}},', '  year = {{' || year || '}},',
        '  doi = {{' || {_bib('doi')} || '}},', '  journal = {{' || {_bib('venue')} || '}},', '}}' || {_NL})) AS entry FROM done""".replace("{{", "{").replace("}}", "}"),
    ),
)
def e3(t: Tables) -> DataFrame:
    return E.to_bibtex(t.knowledge().papers)


@query(
    "e4_csl",
    sql(
        "done",
        """SELECT paper_id, title, array_to_string(list_transform(authors, lambda a: CASE WHEN a = 'Cher' THEN '/Cher'
        ELSE split_part(a, ' ', 2) || '/Customer' END), ';') AS authors, coalesce(abstract, '') AS abstract, year, coalesce(doi, '') AS doi,
        venue, doi IS NOT NULL AS has_doi FROM done""",
    ),
)
def e4(t: Tables) -> DataFrame:
    """Fields read back from the JSON item."""
    parsed = F.from_json(
        "csl",
        "title string, author array<struct<family: string, given: string>>, abstract string, "
        "issued struct<`date-parts`: array<array<int>>>, DOI string, `container-title` string",
    )
    rows = E.to_csl(t.knowledge().papers).select("paper_id", "csl", parsed.alias("c"))
    return rows.select(
        "paper_id", "c.title",
        F.array_join(F.transform("c.author", lambda a: F.concat_ws("/", a["family"], a["given"])), ";").alias("authors"),
        "c.abstract", F.get(F.get("c.issued.date-parts", F.lit(0)), F.lit(0)).alias("year"),
        E.text_or_empty("c.DOI").alias("doi"), F.col("c.container-title").alias("venue"),
        F.contains("csl", F.lit('"DOI"')).alias("has_doi"),
    )


def _section_sql(head: str, rows: str, table: str, order: str, blank: bool = True) -> str:
    tail = f" || {_NL}" if blank else ""
    return f"(SELECT '{head}' || {_NL} || string_agg({rows}, {_NL} ORDER BY {order}){tail} FROM {table} x WHERE x.paper_id = d.paper_id)"


_PAPER_NOTE = f"""SELECT paper_id, concat_ws({_NL}, '---', 'title: ' || {_yaml('title')},
  'authors: [' || array_to_string(list_transform(authors, lambda a: {_yaml('a')}), ', ') || ']', 'year: ' || year, 'doi: ' || {_yaml('doi')},
  'tags: [' || array_to_string(list_transform(keywords, lambda a: {_yaml('a')}), ', ') || ']', 'paperlake_id: ' || {_yaml('paper_id')},
  '---' || {_NL}, '# ' || title || {_NL}, '## Metadata', '- **Authors**: ' || array_to_string(authors, ', '), '- **Year**: ' || year,
  '- **Venue**: ' || venue, '- **DOI**: [' || doi || '](https://doi.org/' || doi || ')', '',
  '## Abstract' || {_NL} || abstract || {_NL}, es, rs, fs, ms, cs) AS content
FROM done d
LEFT JOIN (SELECT paper_id, '## Key Concepts' || {_NL} || string_agg('- [[' || name || ']] (' || type || ') - ' || definition, {_NL} ORDER BY first_chunk, first_pos) || {_NL} AS es FROM ents GROUP BY 1) USING (paper_id)
LEFT JOIN (SELECT paper_id, '## Relationships' || {_NL} || string_agg('- [[' || source || ']] **' || type || '** [[' || target || ']]', {_NL} ORDER BY chunk_no, pos) || {_NL} AS rs FROM rels GROUP BY 1) USING (paper_id)
LEFT JOIN (SELECT paper_id, '## Key Findings' || {_NL} || string_agg('- **' || CASE type WHEN 'main_result' THEN 'Main_Result' ELSE 'Limitation' END || '**: ' || statement ||
   CASE WHEN evidence <> '' THEN {_NL} || '  - Evidence: ' || evidence ELSE '' END, {_NL} ORDER BY pos) || {_NL} AS fs FROM findings GROUP BY 1) USING (paper_id)
LEFT JOIN (SELECT paper_id, '## Methods' || {_NL} || string_agg('### ' || CASE WHEN l_discount > 0 THEN p_name ELSE 'Method' END || {_NL} || p_type || {_NL}, {_NL} ORDER BY pos) AS ms FROM items WHERE chunk_no = 1 GROUP BY 1) USING (paper_id)
LEFT JOIN (SELECT paper_id, '## Flashcards' || {_NL} || string_agg('**Q:** ' || front || {_NL} || '**A:** ' || back || {_NL}, {_NL} ORDER BY pos) AS cs FROM kcards GROUP BY 1) USING (paper_id)"""


@query("e5_paper_notes", sql("done ents rels findings items kcards", _PAPER_NOTE))
def e5(t: Tables) -> DataFrame:
    return E.paper_notes(t.knowledge(keep=True)).select("paper_id", "content")


_DONE_FIRSTS = """, g AS (SELECT e.*, d.user_id, d.created_at, d.title FROM ents e JOIN done d USING (paper_id)),
  f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id, entity_key ORDER BY created_at, paper_id, first_chunk, first_pos) = 1),
"""
_ENTITY_NOTE = f"""{_DONE_FIRSTS} ls AS (SELECT user_id, entity_key, string_agg('- [[' || title || ']]', {_NL} ORDER BY created_at, paper_id, first_chunk, first_pos) AS l FROM g GROUP BY 1, 2)
SELECT user_id, entity_key, concat_ws({_NL}, '---', 'type: ' || type, 'aliases: [''' || alias || ''']', '---' || {_NL}, '# ' || name || {_NL}, definition || {_NL},
  '## Appears In', l, '') AS content FROM f JOIN ls USING (user_id, entity_key)"""


@query("e6_entity_notes", sql("ents done", _ENTITY_NOTE))
def e6(t: Tables) -> DataFrame:
    return E.entity_notes(t.knowledge(keep=True)).select("user_id", "entity_key", "content")


def _linked(t: Tables):
    """Paths and links of a whole vault per user, as a sync run resolves them; stored, since notes read them repeatedly."""
    kb, mapping = t.knowledge(keep=True), _mapping(t)
    papers = kb.papers.select("paper_id", X.sanitize_name(N.note_title(kb.papers)).alias("target"))
    entities = stored(K.note_entities(kb.papers, kb.entities.select("*", F.col("first_chunk").alias("chunk_no"), F.col("first_pos").alias("pos"), F.lit("").alias("entity_type"), F.lit("").alias("description")), kb.entities))
    links = stored(entities.groupBy("user_id", "entity_key").agg(F.min("name").alias("name")).select(
        "user_id", "entity_key", X.sanitize_name(F.col("name")).alias("target")
    ))
    return kb, mapping, papers, entities, links


def _block_sql(sec: int, table: str, line: str, order: str, name: str, blank: bool = True) -> str:
    tail = f" || {_NL}" if blank else ""
    return f"""LEFT JOIN (SELECT paper_id, '{HEADINGS[sec]}' || {_NL} || string_agg({line}, {_NL} ORDER BY {order}){tail} AS {name}
      FROM {table} GROUP BY 1) USING (paper_id)"""


_CARD_SQL = f"""'### 卡片 ' || n || {_NL} || '- 问：' || front || {_NL} || '- 答：' || back || {_NL} || '- 标签：' || tag || {_NL} || '- 难度：' || difficulty || '/5' || {_NL} ||
  '- 下次复习：2024-02-01T00:00:00' || {_NL}"""
_LINKED_PAPER = f""", ne AS (SELECT d.user_id, e.paper_id, {_squeeze('lower(name)')} AS k, trim(name) AS name, e.name AS raw, type, definition, first_chunk, first_pos
    FROM ents e JOIN done d USING (paper_id)),
  lk AS (SELECT user_id, k, {_sanitize('min(name)')} AS target FROM ne GROUP BY 1, 2),
  en AS (SELECT ne.*, target FROM ne JOIN lk USING (user_id, k)),
  rl AS (SELECT r.*, coalesce(a.target, {_sanitize('r.source')}) AS s, coalesce(b.target, {_sanitize('r.target')}) AS g FROM rels r JOIN done d USING (paper_id)
    LEFT JOIN lk a ON a.user_id = d.user_id AND a.k = lower(r.source) LEFT JOIN lk b ON b.user_id = d.user_id AND b.k = lower(r.target)),
  it AS (SELECT items.* FROM items SEMI JOIN done USING (paper_id)),
  own AS (SELECT l.* FROM live l JOIN done d ON l.paper_id = d.paper_id AND l.user_id = d.user_id),
  cd AS (SELECT paper_id, front, back, tag, difficulty, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS n FROM kcards ANTI JOIN own USING (paper_id)
    UNION ALL SELECT paper_id, front, back, back, 3, row_number() OVER (PARTITION BY paper_id ORDER BY card_id) FROM own),
  an AS (SELECT a.* FROM annots a JOIN done d ON a.paper_id = d.paper_id AND a.user_id = d.user_id)
SELECT paper_id, regexp_replace(concat_ws({_NL}, '---', 'paperlake_id: ' || {_yaml('paper_id')}, 'paperlake_type: "paper"', 'title: ' || {_yaml('title')}, '---' || {_NL},
  '# ' || title || {_NL}, '个人笔记：[[' || {_sanitize(_sanitize('title') + " || ' - Notes'")} || ']]' || {_NL}, '{HEADINGS[2]}',
  '- 作者：' || CASE WHEN o_orderkey % 2 = 0 THEN authors[1] || ' (' || split_part(title, '/', 1) || '), Cher' ELSE authors[1] END, '- 年份：' || year, '- 会议/期刊：' || venue,
  '- DOI：' || doi, '- 关键词：' || array_to_string(keywords, ', '), '', '{HEADINGS[3]}' || {_NL} || abstract || {_NL}, b5, b6, b7, b8, b9, b10, b11, b12), '[ \\s]+$', '') || {_NL} AS content
FROM done
{_block_sql(5, "it WHERE chunk_no IN (4, 5)", "CASE chunk_no WHEN 5 THEN '  ' ELSE '' END || '- ' || p_name || '：' || p_brand", "ord", "b5")}
{_block_sql(6, "en", "'- [[' || target || ']] (' || type || ')：' || definition", "first_chunk, first_pos", "b6")}
{_block_sql(7, "rl", "'- [[' || s || ']] **' || type || '** [[' || g || ']]：' || description || '（置信度：' || confidence || '）'", "chunk_no, pos", "b7")}
{_block_sql(8, "findings", f"'- ' || statement || CASE WHEN evidence <> '' THEN {_NL} || '  - 证据：' || evidence ELSE '' END", "pos", "b8")}
{_block_sql(9, "it WHERE chunk_no = 1", f"'### ' || CASE WHEN l_discount > 0 THEN p_name ELSE 'Method' END || {_NL} || p_type || {_NL} || '- 输入：' || p_brand || {_NL}", "pos", "b9", blank=False)}
{_block_sql(10, "it WHERE chunk_no = 2", f"'- ' || p_brand || '：' || p_type || CASE WHEN l_linestatus = 'O' THEN {_NL} || '  - 用途：training' ELSE '' END", "pos", "b10")}
{_block_sql(11, "cd", _CARD_SQL, "n", "b11", blank=False)}
{_block_sql(12, "an", "'- ' || type || '（' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '）：' || content", "created_at, annotation_id", "b12")}"""


@query("e7_linked_paper_notes", sql("ents rels done items findings kcards live annots", _LINKED_PAPER))
def e7(t: Tables) -> DataFrame:
    kb, _, papers, _, links = _linked(t)
    live = t.live_cards().withColumns({"tags": F.array("back"), "difficulty": F.lit(3), "next_review": now()})
    notes = N.linked_paper_notes(kb, papers, links, live_cards=live, live_annotations=t.annotations())
    return notes.select("paper_id", "content")


_LINKED_ENTITY = f""", ne AS (SELECT d.user_id, d.created_at, e.paper_id, {_squeeze('lower(name)')} AS k, trim(name) AS name, type, definition
    FROM ents e JOIN done d USING (paper_id)),
  f AS (SELECT * FROM ne QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY created_at, paper_id) = 1),
  lk AS (SELECT user_id, k, {_sanitize('min(name)')} AS target FROM ne GROUP BY 1, 2),
  pairs AS (SELECT user_id, k, paper_id FROM ne UNION SELECT user_id, 'hot rod', paper_id FROM done WHERE o_orderkey % 2 = 0),
  tg AS (SELECT p.user_id, p.k, CASE WHEN o_orderkey % 2 = 0 THEN 'Old ' || paper_id ELSE {_sanitize('title')} END AS target, min(paper_id) AS paper_id
    FROM pairs p JOIN done USING (paper_id) GROUP BY 1, 2, 3),
  ls AS (SELECT user_id, k, string_agg('- [[' || target || ']]', {_NL} ORDER BY paper_id) AS l FROM tg GROUP BY 1, 2),
  ends AS (SELECT d.user_id, r.*, lower(source) AS s, lower(target) AS g FROM rels r JOIN done d USING (paper_id)),
  inc AS (SELECT user_id, s AS k, * EXCLUDE (user_id) FROM ends UNION ALL SELECT user_id, g, * EXCLUDE (user_id) FROM ends WHERE s <> g),
  rl AS (SELECT i.user_id, i.k, string_agg('- [[' || coalesce(a.target, {_sanitize('i.source')}) || ']] **' || i.type || '** [[' || coalesce(b.target, {_sanitize('i.target')}) || ']]：' || i.description,
      {_NL} ORDER BY i.paper_id, i.chunk_no, i.pos) AS l FROM inc i LEFT JOIN lk a ON a.user_id = i.user_id AND a.k = i.s LEFT JOIN lk b ON b.user_id = i.user_id AND b.k = i.g GROUP BY 1, 2)
SELECT f.user_id, f.k AS entity_key, concat_ws({_NL}, '---', 'paperlake_type: "entity"', 'paperlake_entity_key: ' || {_yaml('f.k')}, 'name: ' || {_yaml('f.name')},
  'type: ' || {_yaml('f.type')}, '---' || {_NL}, '# ' || f.name || {_NL}, f.definition || {_NL}, '{APPEARS_IN}', ls.l, CASE WHEN rl.l IS NOT NULL THEN {_NL} || '{RELATED}' || {_NL} || rl.l END) || {_NL} AS content
FROM f LEFT JOIN ls USING (user_id, k) LEFT JOIN rl USING (user_id, k)"""


@query("e8_linked_entity_notes", sql("ents rels done", _LINKED_ENTITY))
def e8(t: Tables) -> DataFrame:
    kb, mapping, papers, entities, links = _linked(t)
    paper_links = K.entity_paper_links(mapping, kb.entities, kb.papers)
    relations = K.with_paper(kb.relations, kb.papers, "user_id")
    ordered = K.with_paper(entities, kb.papers, "created_at")
    return N.linked_entity_notes(ordered, paper_links, relations, links).select("user_id", "entity_key", "content")


@query(
    "e9_export_documents",
    sql(
        "done ents rels global_",
        """SELECT 'paper' AS kind, paper_id AS id, title AS name, CAST(year AS BIGINT) AS year, coalesce(e, 0) AS items FROM done
          LEFT JOIN (SELECT paper_id, count(*) AS e FROM ents GROUP BY 1) USING (paper_id)
        UNION ALL SELECT 'entity', user_id || '/' || entity_key, name, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (
          SELECT g.* FROM global_ g SEMI JOIN done USING (paper_id)
          QUALIFY row_number() OVER (PARTITION BY g.user_id, entity_key ORDER BY g.created_at, g.paper_id, first_chunk, first_pos) = 1)
        UNION ALL SELECT 'manifest', '1.0.0', '2024-02-01', 0, 0""",
    ),
)
def e9(t: Tables) -> DataFrame:
    """The full export, written and read back: every part of the papers, the global entities, and the manifest."""
    kb, path = t.knowledge(keep=True), new_path(t.spark, "export")
    D.export_all(D.assemble_documents(kb, now(), "m"), K.global_entities(kb.entities, kb.papers), "2024-02-01", path, "gzip")
    papers = t.spark.read.schema(DOCUMENT).json(f"{path}/papers")
    zero = F.lit(0).cast("bigint")
    heads = papers.groupBy("id").agg(
        F.max("metadata.title").alias("name"), F.max("metadata.year").cast("bigint").alias("year"),
        F.sum(F.size("entities")).cast("bigint").alias("items"),
    )
    entities = t.spark.read.schema("user_id long, entity_key string, name string").json(f"{path}/global_entities")
    manifest = t.spark.read.schema("schema_version string, exported_at string").json(f"{path}/manifest")
    return (
        heads.select(F.lit("paper").alias("kind"), "id", "name", "year", "items")
        .unionByName(entities.select(F.lit("entity").alias("kind"), F.concat_ws("/", "user_id", "entity_key").alias("id"), "name", zero.alias("year"), zero.alias("items")))
        .unionByName(manifest.select(F.lit("manifest").alias("kind"), F.col("schema_version").alias("id"), F.col("exported_at").alias("name"), zero.alias("year"), zero.alias("items")))
    )


@query(
    "e10_notes_table",
    sql(
        "done ents rels findings items kcards",
        f"""SELECT user_id || '/papers/' || {_safe('title')} || '.md' AS relative_path, sha256(content) AS content_hash
          FROM done JOIN ({_PAPER_NOTE}) n USING (paper_id)
        UNION ALL SELECT user_id || '/entities/' || {_safe('name')} || CASE WHEN entity_key <> min(entity_key) OVER (PARTITION BY user_id, lower({_safe('name')}))
            THEN '-' || substr(sha256(entity_key), 1, 16) ELSE '' END || '.md', sha256(content)
          FROM (WITH {_ENTITY_NOTE.lstrip(', ').replace('SELECT user_id, entity_key, concat_ws', 'SELECT user_id, entity_key, name, concat_ws')})""",
    ),
)
def e10(t: Tables) -> DataFrame:
    notes = E.notes_table(t.knowledge(keep=True), whole=True)
    return notes.select("relative_path", F.sha2("content", 256).alias("content_hash"))


@query(
    "s6_export_sinks",
    sql(
        "ents done",
        """SELECT f AS format, e.id, e.name, e.definition FROM ents e JOIN done USING (paper_id), unnest(['csv', 'json', 'text']) AS u(f)""",
    ),
)
def s6(t: Tables) -> DataFrame:
    """Entity rows written as CSV, JSON lines and text, and read back."""
    rows = stored(E.export_entities(t.knowledge()))
    path = new_path(t.spark, "sinks")
    S.write_export(rows, "csv", f"{path}/csv")
    S.write_export(rows, "json", f"{path}/json")
    S.write_export(rows.select(F.to_json(F.struct("id", "name", "definition")).alias("value")), "text", f"{path}/text")
    schema = "id string, name string, definition string"
    csv = t.spark.read.options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", quote='"', escape='"', multiLine="true").csv(f"{path}/csv").select("id", "name", "definition")
    text = t.spark.read.text(f"{path}/text").select(F.inline(F.array(F.from_json("value", schema))))
    json = t.spark.read.schema(schema).json(f"{path}/json")
    out = [df.select(F.lit(name).alias("format"), "id", "name", "definition") for name, df in (("csv", csv), ("json", json), ("text", text))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "s4_read_notes",
    sql("done", f"SELECT user_id || '/papers/' || {_safe('title')} || '.md' AS relative_path, title, paper_id AS note_id FROM done"),
)
def s4_files(t: Tables) -> DataFrame:
    """Paper notes written as files in the run, read back with their front matter."""
    kb = t.knowledge(keep=True)
    names = kb.papers.select("paper_id", "user_id", X.safe_filename(F.col("title")).alias("name"))
    paths = E.note_paths(names, "papers", F.col("paper_id"))
    root = new_path(t.spark, "vault")
    write_note_files(E.paper_notes(kb).join(paths, "paper_id"), root)
    m = F.col("front_matter")
    return read_note_heads(t.spark, root).select("relative_path", m["title"].alias("title"), m["paperlake_id"].alias("note_id"))
