"""Independent SQL for the registered queries, to be run by another engine on the same tables."""

from __future__ import annotations

# Fixed values, written out here so that a wrong constant of the library does not pass its own check.
ABBREVIATIONS = (
    "et", "al", "etal", "fig", "figs", "eq", "eqs", "no", "nos", "vs", "cf", "ie", "eg", "pp", "vol", "sec",
    "secs", "ref", "refs", "tab", "tabs", "approx", "resp", "viz", "mr", "mrs", "ms", "dr", "prof", "inc", "ltd",
    "dept", "univ", "ch", "chap", "st", "co", "corp", "eds", "ed",
)
OMISSION = '\n\n[...middle sections omitted for brevity...]\n\n'
ORPHAN_MESSAGE = 'processing interrupted (service restart)'
HEADINGS = {
    1: "## AI 速览",
    2: "## 论文信息",
    3: "## 摘要",
    4: "## AI 总结",
    5: "## 章节结构",
    6: "## 实体",
    7: "## 关系",
    8: "## 发现",
    9: "## 方法",
    10: "## 数据集",
    11: "## 闪卡",
    12: "## 用户笔记",
    13: "## 同步信息",
}
APPEARS_IN, RELATED = "## 出现在哪些论文", "## 相关关系"

# RE2 spelling of Python's white space.
_WS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_STRIP = rf"^{_WS}+|{_WS}+$"
_INNER = r"(?i)(^|[^\p{L}.])(\p{L}|" + "|".join(ABBREVIATIONS) + rf"|[\p{{L}}.]*\.[\p{{L}}.]*)\.({_WS}|$)"
_DOT, _END = "chr(64976)", "chr(64977)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{_STRIP}', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _protect(x: str) -> str:
    return f"regexp_replace({x}, '{_INNER}', '\\1\\2' || {_DOT} || '\\3', 'g')"


def _id(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256({' || chr(31) || '.join(parts)}), 1, 24)"


def _unwrap_once(x: str) -> str:
    return f"regexp_replace({x}, '([A-Za-z0-9])\\n+([A-Za-z0-9])', '\\1 \\2', 'g')"


def _sanitize(x: str) -> str:
    v = f"translate({x}, '/\\#:^<>\"|?*[]', '__         ')"
    v = f"regexp_replace(regexp_replace({v}, '{_WS}+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    v = f"regexp_replace(regexp_replace({v}, '_+', '_', 'g'), '^_|_$', '', 'g')"
    v = f"coalesce(nullif({v}, ''), 'Untitled')"
    return f"coalesce(nullif(regexp_replace(substr({v}, 1, 120), '[ ._]+$', ''), ''), 'Untitled')"


def _safe(x: str) -> str:
    return _strip(f"substr(translate({x}, '<>:\"/\\|?*', '_________'), 1, 100)")


def _yaml(x: str) -> str:
    return f"'\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


def _bib(x: str) -> str:
    for a, b in [
        ("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"),
        ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"),
    ]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


# Named sub-queries; each names those it needs.
PARTS: dict[str, tuple[str, str]] = {
    "papers": (
        "",
        """SELECT 'pk_' || o_orderkey AS paper_id, o_custkey AS user_id, 'task_' || o_orderkey AS task_id,
        o_orderpriority || '/' || o_orderkey AS title,
        CASE WHEN o_orderkey % 3 = 0 THEN '10.1000/x_' || o_orderkey END AS doi,
        CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority || ' & Sons' AS venue,
        CASE WHEN o_orderkey % 2 = 0 THEN ['Customer ' || o_custkey, 'Cher'] ELSE ['Customer ' || o_custkey] END AS authors,
        CASE WHEN o_orderkey % 4 <> 0 THEN '100% of \\Customer ' || o_custkey END AS abstract,
        CASE WHEN o_orderkey % 5 = 0 THEN ['a "b"', o_orderpriority] END AS keywords,
        CASE WHEN o_orderkey % 50 = 0 THEN '@misc{' || o_orderkey || '}' END AS bibtex,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'extracting' ELSE 'error' END AS extraction_status,
        CASE WHEN o_orderstatus = 'P' THEN 'timeout' END AS extraction_error,
        o_orderkey % 7 <> 0 AS has_document, o_orderdate AS created_at, o_orderkey FROM orders""",
    ),
    "done": ("papers", "SELECT * FROM papers WHERE extraction_status = 'completed' AND has_document"),
    "items": (
        "",
        """SELECT 'pk_' || l_orderkey AS paper_id, l_linenumber AS chunk_no,
        l_partkey * 1000000 + l_suppkey AS pos, p_name, p_brand, p_type, l_quantity, l_discount, l_tax, l_returnflag,
        l_linestatus, l_shipdate, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ord
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "mentions": (
        "items",
        """SELECT paper_id, chunk_no, pos, CASE WHEN chunk_no = 7 THEN '  ' || p_name
        WHEN chunk_no % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, lower(p_type) AS type,
        CASE WHEN l_linestatus = 'O' THEN p_brand END AS alias, p_brand AS definition,
        CASE WHEN l_quantity <> 1 THEN l_discount * 10 END AS importance FROM items""",
    ),
    "hubs": ("items", "SELECT paper_id, min(p_name) AS hub FROM items GROUP BY paper_id"),
    "relm": (
        "items hubs",
        """SELECT paper_id, chunk_no, pos, CASE WHEN chunk_no % 2 = 0 THEN upper(p_name) ELSE p_name END AS source,
        CASE WHEN l_returnflag = 'R' THEN hub || '?' ELSE hub END AS target,
        CASE l_returnflag WHEN 'A' THEN 'extends' WHEN 'R' THEN 'uses' END AS type, l_linestatus AS description,
        CASE WHEN l_tax > 0 THEN 1 - l_tax END AS confidence FROM items JOIN hubs USING (paper_id)""",
    ),
    "ranked": (
        "mentions",
        """SELECT *, trim(lower(name)) AS entity_key,
        row_number() OVER (PARTITION BY paper_id, trim(lower(name))
                           ORDER BY coalesce(importance, 0) DESC, chunk_no, pos) AS rk,
        first_value(chunk_no) OVER (PARTITION BY paper_id, trim(lower(name)) ORDER BY chunk_no, pos) AS first_chunk,
        first_value(pos) OVER (PARTITION BY paper_id, trim(lower(name)) ORDER BY chunk_no, pos) AS first_pos
        FROM mentions""",
    ),
    "ents": (
        "ranked",
        f"""SELECT paper_id, entity_key, name, coalesce(type, 'concept') AS type, alias, definition,
        coalesce(importance, 0.5) AS importance, first_chunk, first_pos,
        {_id('ent', 'paper_id', 'entity_key')} AS id FROM ranked WHERE rk = 1""",
    ),
    "rels": (
        "relm ents",
        f"""SELECT r.paper_id, r.chunk_no, r.pos, r.source, r.target, coalesce(r.type, 'uses') AS type, r.description,
        coalesce(r.confidence, 0.5) AS confidence, s.id AS source_entity_id, t.id AS target_entity_id,
        {_id('rel', 'r.paper_id', "CAST(r.chunk_no AS VARCHAR)", "CAST(r.pos AS VARCHAR)")} AS id
        FROM relm r JOIN ents s ON r.paper_id = s.paper_id AND lower(r.source) = lower(s.name)
        JOIN ents t ON r.paper_id = t.paper_id AND lower(r.target) = lower(t.name)""",
    ),
    "findings": (
        "items done",
        """SELECT paper_id, ord AS pos, CASE WHEN l_linestatus = 'O' THEN 'main_result' ELSE 'limitation' END AS type,
        p_name || ' x' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS statement,
        CASE WHEN chunk_no % 2 = 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS evidence
        FROM items SEMI JOIN done USING (paper_id) WHERE l_returnflag = 'R'""",
    ),
    "kcards": (
        "items done",
        """SELECT paper_id, pos, 'What is ' || p_name || '?' AS front, p_brand AS back, lower(p_type) AS tag,
        CAST(l_quantity AS INTEGER) % 5 + 1 AS difficulty
        FROM items SEMI JOIN done USING (paper_id) WHERE chunk_no = 3""",
    ),
    "cards": (
        "",
        "SELECT DISTINCT user_id || ':' || event_type AS card_id, user_id, event_type FROM events",
    ),
    "log": (
        "",
        """SELECT user_id || ':' || event_type AS card_id, event_id % 6 AS q, ts,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events""",
    ),
    "folded": (
        "log",
        """SELECT card_id, 0 AS n, 0 AS reps, CAST(1.0 AS DOUBLE) AS iv, CAST(2.5 AS DOUBLE) AS ease,
            CAST(NULL AS TIMESTAMP) AS ts FROM (SELECT DISTINCT card_id FROM log)
        UNION ALL
        SELECT f.card_id, f.n + 1, CASE WHEN l.q >= 3 THEN f.reps + 1 ELSE 0 END,
            CASE WHEN l.q < 3 THEN 1.0 WHEN f.reps = 0 THEN 1.0 WHEN f.reps = 1 THEN 6.0 ELSE f.iv * f.ease END,
            greatest(CAST(1.3 AS DOUBLE), f.ease + CAST(0.1 AS DOUBLE) - (5 - l.q) * (CAST(0.08 AS DOUBLE) + (5 - l.q) * CAST(0.02 AS DOUBLE))),
            l.ts FROM folded f JOIN log l ON l.card_id = f.card_id AND l.n = f.n + 1""",
    ),
    "state": (
        "folded",
        """SELECT card_id, CAST(split_part(card_id, ':', 1) AS BIGINT) AS user_id, reps, iv, ease, ts AS last_review,
        ts + to_microseconds(CAST(round(iv * 86400000000) AS BIGINT)) AS next_review
        FROM folded QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY n DESC) = 1""",
    ),
    "split": (
        "",
        f"""SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace({_protect(_protect('text'))},
            '\\.({_WS}|$)', '.' || {_END} || '\\1', 'g'), '([。！？!?；;])', '\\1' || {_END}, 'g'), {_END})) AS raw,
        generate_subscripts(string_split(regexp_replace(regexp_replace({_protect(_protect('text'))},
            '\\.({_WS}|$)', '.' || {_END} || '\\1', 'g'), '([。！？!?；;])', '\\1' || {_END}, 'g'), {_END}), 1) AS i
        FROM documents""",
    ),
    "sentences": (
        "split",
        f"""SELECT doc_id, s AS text, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM
        (SELECT doc_id, i, replace({_squeeze('raw')}, {_DOT}, '.') AS s FROM split) WHERE length(s) >= 12""",
    ),
    "packed": (
        "sentences",
        """SELECT doc_id, n, 0 AS chunk_no, length(text) AS chars, 1 AS items FROM sentences WHERE n = 1
        UNION ALL
        SELECT s.doc_id, s.n,
            CASE WHEN p.chars + length(s.text) > 5000 OR p.items >= 60 THEN p.chunk_no + 1 ELSE p.chunk_no END,
            CASE WHEN p.chars + length(s.text) > 5000 OR p.items >= 60 THEN length(s.text) ELSE p.chars + length(s.text) END,
            CASE WHEN p.chars + length(s.text) > 5000 OR p.items >= 60 THEN 1 ELSE p.items + 1 END
        FROM packed p JOIN sentences s ON s.doc_id = p.doc_id AND s.n = p.n + 1""",
    ),
    "pages_": (
        "",
        """SELECT doc_id AS paper_id, unnest(string_split(text, chr(10))) AS text,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_no FROM documents""",
    ),
    "texts": (
        "pages_",
        f"""SELECT paper_id, count(*) FILTER (filled) AS n_pages,
        coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_no) FILTER (filled), '') AS text,
        coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_no) FILTER (filled AND rn <= 2), '') AS first_pages
        FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, filled ORDER BY page_no) AS rn
              FROM (SELECT *, {_strip('text')} <> '' AS filled FROM pages_)) GROUP BY paper_id""",
    ),
    "titled": (
        "",
        """SELECT doc_id AS paper_id, text, lower(text) AS low, length(text) AS n, list_filter(
            [string_split(string_split(text, chr(10))[2], ' ')[1], string_split(string_split(text, chr(10))[4], ' ')[1]],
            lambda t: t IS NOT NULL) AS titles FROM documents""",
    ),
    "placed": (
        "titled",
        """SELECT *, list_sort(list_filter(list_transform(titles,
            lambda t: CASE WHEN t = '' THEN 1 ELSE instr(low, lower(t)) END), lambda p: p > 0)) AS starts FROM titled""",
    ),
    "bounded": (
        "placed",
        "SELECT *, CASE WHEN starts[1] > 1 THEN list_concat([1], starts) ELSE starts END AS bounds FROM placed",
    ),
    "cut": (
        "bounded",
        """SELECT paper_id, text, CASE WHEN len(titles) = 0 THEN [text]
            WHEN len(starts) < 2 THEN list_transform(range(0, n, 2000), lambda b: substr(text, b + 1, 2000))
            ELSE list_transform(range(1, len(bounds) + 1), lambda i: substr(text, bounds[i],
                coalesce(bounds[i + 1], n + 1) - bounds[i])) END AS chunks FROM bounded""",
    ),
    "picked": (
        "sentences",
        """SELECT doc_id, 'p1_s' || n AS sentence_id, n AS ord, ['core_conclusion', 'method_innovation', 'key_data',
            'background'][CAST(n / 3 AS INTEGER) % 4 + 1] AS category FROM sentences WHERE n % 3 = 0
        UNION ALL SELECT doc_id, 'p1_s3', 1000000000, 'key_data' FROM documents
        UNION ALL SELECT doc_id, 'p9_s999', 1000000001, 'key_data' FROM documents""",
    ),
    "sel": ("picked", "SELECT * FROM picked WHERE category <> 'background'"),
    "applied": (
        "sel sentences",
        """SELECT f.doc_id, f.sentence_id, f.category, s.text, s.n IS NOT NULL AS matched FROM
        (SELECT doc_id, sentence_id, arg_min(category, ord) AS category FROM sel GROUP BY doc_id, sentence_id) f
        LEFT JOIN sentences s ON s.doc_id = f.doc_id AND 'p1_s' || s.n = f.sentence_id""",
    ),
    "stats": (
        "applied",
        """SELECT doc_id, count(*) FILTER (matched AND category = 'core_conclusion') AS core_conclusions,
        count(*) FILTER (matched AND category = 'method_innovation') AS method_innovations,
        count(*) FILTER (matched AND category = 'key_data') AS key_data,
        count(*) FILTER (matched) AS total, count(*) FILTER (NOT matched) AS failed_matches
        FROM applied GROUP BY doc_id""",
    ),
    "annots": (
        "papers",
        """SELECT 'ann_' || conv_id || '_' || turn AS annotation_id, paper_id,
        CASE WHEN turn % 4 = 3 THEN -1 ELSE user_id END AS user_id, role AS type, text AS content,
        TIMESTAMP '2024-01-01' + to_hours(turn) AS created_at
        FROM conversations JOIN papers ON paper_id = 'pk_' || conv_id""",
    ),
    "live": (
        "cards papers",
        """SELECT card_id, paper_id, CASE WHEN c.user_id % 2 = 0 THEN p.user_id ELSE c.user_id END AS user_id,
        card_id AS front, event_type AS back FROM cards c JOIN papers p ON paper_id = 'pk_' || c.user_id""",
    ),
    "tasks": (
        "",
        """SELECT 't_' || event_id AS task_id, user_id, CASE event_type WHEN 'purchase' THEN 'completed'
        WHEN 'error' THEN 'error' WHEN 'click' THEN 'rewriting' ELSE 'pending' END AS status, ts AS created_at FROM events""",
    ),
    "links": (
        "",
        """SELECT page_id, unnest(['own', 'abs', 'pdf', 'blob', 'private', 'special', 'ftp', 'local', 'v6', 'loopback',
        'short', 'decimal', 'hex', 'octal', 'public', 'dot']) AS kind,
        unnest([url, 'https://arxiv.org/abs/' || page_id || '/', 'http://www.arxiv.org/pdf/' || page_id,
            ' github.com/a/b/blob/main/' || page_id || '.pdf ', 'http://10.0.0.' || page_id % 256 || '/x',
            'http://198.51.100.' || page_id % 256 || ':8080/x/', 'ftp://files.example.org/' || page_id,
            'http://user@H' || page_id || '.local/x?y=1', 'http://[fe80::' || page_id % 256 || ']/x.y#z',
            'https://LOCALHOST:' || page_id || '/', 'http://127.' || page_id % 256 || '/x', 'http://' || (2130706432 + page_id % 256) || '/',
            'http://0X0a' || lpad(hex(page_id % 256), 6, '0') || '/a.pdf', 'http://0300.0250.01.' || page_id % 256,
            'http://8.8.4.' || page_id % 256 || '/y', 'http://localhost./' || page_id]) AS link FROM pages""",
    ),
    "global_": (
        "ents papers",
        """SELECT e.*, p.user_id, p.created_at, p.title FROM ents e JOIN papers p USING (paper_id)""",
    ),
    "firsts": (
        "global_",
        """SELECT * FROM global_ QUALIFY row_number() OVER (PARTITION BY user_id, entity_key
            ORDER BY created_at, paper_id, first_chunk, first_pos) = 1""",
    ),
}


def sql(needs: str, body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in PARTS[name][0].split():
                visit(need)
            order.append(name)

    for need in needs.split():
        visit(need)
    head = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in order)
    return f"WITH RECURSIVE {head}\n{body}" if order else body


STAMP = "'%Y-%m-%d %H:%M:%S'"
OMITTED = OMISSION.replace("\n", "' || chr(10) || '")
