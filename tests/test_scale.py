"""Plans that must not grow: inputs are read once, and rows are shuffled no more often than their work needs."""

from datetime import datetime

import pytest

from paperlake.operators import export as E
from paperlake.operators import knowledge as K
from paperlake.operators import queries as Q
from paperlake.plans.bindings import Tables, now
from paperlake.sources import dictionary
from paperlake.sources import documents as D

DAY = datetime(2024, 1, 1)
ROWS = {
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
        [(1, 5, "F", 1.0, DAY, "High"), (2, 5, "F", 1.0, DAY, "Low"), (3, 5, "O", 1.0, DAY, "High"), (None, 5, "F", 1.0, DAY, "High")],
    ),
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        [(1, "hot rod", "B1", "TIN", 1, 1.0), (2, "cold rod", "B2", "TIN", 1, 1.0), (3, None, "B3", "TIN", 1, 1.0)],
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        [
            (order, part, 1, line, 2.0, 1.0, 0.1, 0.1, flag, "O", DAY)
            for order, part, line, flag in (
                (1, 1, 1, "N"), (1, 2, 2, "A"), (1, 2, 3, "R"), (2, 1, 1, "N"), (2, 1, 1, "N"), (2, 3, 2, "N"), (3, 2, 1, "N"), (None, 1, 1, "N"),
            )
        ],
    ),
    "conversations": ("conv_id long, turn long, role string, text string", [(1, 0, "user", "hello")]),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("papers"))
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Tables(spark, folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_relations_read_the_items_once(tables):
    found = tables.relation_mentions()
    assert scans(found) == 2  # lineitem and part
    got = sorted((r.paper_id, r.chunk_no, r.source or "", r.target) for r in found.collect())
    assert got == [
        ("pk_1", 1, "hot rod", "cold rod"), ("pk_1", 2, "COLD ROD", "cold rod"), ("pk_1", 3, "cold rod", "cold rod?"),
        ("pk_2", 1, "hot rod", "hot rod"), ("pk_2", 1, "hot rod", "hot rod"), ("pk_2", 2, "", "hot rod"),
        ("pk_3", 1, "cold rod", "cold rod"),
    ]
    assert scans(tables.entity_answers()) == 2


def test_knowledge_makes_entities_of_its_papers_only(tables):
    kb = tables.knowledge(keep=True)
    assert scans(kb.entities) == scans(kb.relations) == 1
    assert {r.paper_id for r in kb.entities.collect()} == {r.paper_id for r in kb.relations.collect()} == {"pk_1", "pk_2"}
    # The lines of whole notes are shuffled once.
    notes = E.paper_notes(kb)
    assert shuffles(notes) == 1
    assert {r.paper_id: r.content.count("- [[") for r in notes.select("paper_id", "content").collect() if r.paper_id} == {"pk_1": 4, "pk_2": 3}


def test_items_of_other_papers_are_left_out_before_parts_are_looked_up(tables):
    kept = tables.papers().filter("extraction_status = 'completed'")
    found = tables.items_of(kept)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")
    assert sorted(found.collect()) == sorted(tables.items().join(kept.select("paper_id"), "paper_id", "left_semi").select(found.columns).collect())


def test_documents_are_dealt_once(tables):
    docs = D.assemble_documents(tables.knowledge(keep=True), now(), "m")
    assert shuffles(docs) == 2  # items and heads
    assert sorted((r.paper_id, r.part_no) for r in docs.collect() if r.paper_id) == [("pk_1", 0), ("pk_2", 0)]


def test_exports_are_the_same_compressed(spark, tmp_path):
    docs = spark.createDataFrame([('{"id": "a"}',), ('{"id": "b"}',)], "knowledge_json string")
    entities = spark.createDataFrame([(1, "k")], "user_id long, entity_key string")
    read = {}
    for codec in (None, "gzip"):
        path = str(tmp_path / f"{codec}")
        D.export_all(docs, entities, "2024-01-01", path, codec)
        read[codec] = [sorted(r.value for r in spark.read.text(f"{path}/{part}").collect()) for part in ("papers", "global_entities", "manifest")]
        assert any((tmp_path / f"{codec}" / "papers").glob("*.gz")) == (codec == "gzip")
    assert read[None] == read["gzip"] and read[None][0] == ['{"id": "a"}', '{"id": "b"}']


def test_whole_notes_are_put_together_where_their_lines_are(tables):
    kb = tables.knowledge(keep=True)
    parts, whole = E.notes_table(kb), E.notes_table(kb, whole=True)
    assert whole.columns == ["relative_path", "user_id", "content"]
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(relative_path" not in plan  # the notes' texts are not shuffled by path
    by_path = E.whole_notes(parts, ["relative_path"])
    assert sorted((r.relative_path, r.content) for r in whole.collect()) == sorted((r.relative_path, r.content) for r in by_path.collect())


def test_entities_stay_dealt_by_paper(tables):
    owned = K.with_paper(tables.entities(), tables.papers(), "user_id")
    plain = shuffles(tables.mentions())
    assert shuffles(owned) == plain + 2  # mentions and papers


def test_relations_are_resolved_where_they_were_made(tables):
    made = 6  # for either kind line items and parts by part, and what comes of them by paper
    relations = tables.relations()
    assert shuffles(relations) == made
    # Edges with their owner shuffle the papers; neighbours shuffle the edges by node.
    assert shuffles(K.with_paper(relations, tables.papers(), "user_id")) == made + 1
    assert shuffles(Q.neighbours(tables.entities(), relations)) == made + 1
    got = sorted((r.paper_id, r.chunk_no, r.source_name, r.target_name) for r in relations.collect())
    assert got == [
        ("pk_1", 1, "hot rod", "COLD ROD"), ("pk_1", 2, "COLD ROD", "COLD ROD"), ("pk_2", 1, "hot rod", "hot rod"),
        ("pk_2", 1, "hot rod", "hot rod"), ("pk_3", 1, "cold rod", "cold rod"),
    ]


def test_relations_meet_every_entity_of_their_ends(spark):
    """As joins by paper and name would: repeated names give a relation for each, nulls meet nothing."""
    entities = spark.createDataFrame(
        [("a", "X", "e1"), ("a", "x", "e2"), ("a", "y", "e3"), ("a", None, "e4"), (None, "x", "e5"), ("b", "x", "e6")], "paper_id string, name string, id string"
    )
    mention = "paper_id string, chunk_no int, pos long, source string, target string, type string, description string, confidence double"
    rows = [("a", 0, 0, "x", "Y", None, "d", None), ("a", 0, 0, "x", "Y", None, "d", None), ("a", 1, 0, "X", "x", "t", None, 0.1),
            ("a", 2, 0, None, "y", "t", "d", 0.1), ("a", 3, 0, "y", None, "t", "d", 0.1), (None, 4, 0, "x", "x", "t", "d", 0.1), ("b", 5, 0, "x", "y", "t", "d", 0.1)]
    found = K.resolve_relations(spark.createDataFrame(rows, mention), entities)
    got = sorted((r.paper_id, r.chunk_no, r.source_entity_id, r.target_entity_id, r.type, r.confidence) for r in found.collect())
    assert got == sorted(
        [("a", 0, s, "e3", "uses", 0.5) for s in ("e1", "e2")] * 2 + [("a", 1, s, t, "t", 0.1) for s in ("e1", "e2") for t in ("e1", "e2")]
    )
    assert found.columns == ["paper_id", "chunk_no", "pos", "source", "target", "type", "description", "confidence",
                             "source_entity_id", "source_name", "target_entity_id", "target_name", "id"]


def test_dictionaries_are_merged_within_buckets(spark, tables):
    place = "bucket int, user_id long, entity_key string, created_at timestamp_ntz, paper_id string, first_chunk int, first_pos long, title string"
    old = spark.createDataFrame([(0, 1, "k", DAY, "a", 0, 0, "old"), (0, 1, "k", DAY, "b", 0, 0, "old"), (0, None, "k", DAY, "a", 0, 0, "old")], place)
    new = spark.createDataFrame([(0, 1, "k", DAY, "a", 1, 0, "new"), (0, 1, "k", DAY, "a", 2, 0, "new"), (0, None, "k", DAY, "a", 0, 0, "new")], place)
    merged = dictionary._replaced(old.repartition("bucket"), new.repartition("bucket"))
    assert shuffles(merged) == 2
    # A paper that comes again gives way; what has no owner is no paper's, as in a join.
    got = sorted((r.user_id or 0, r.paper_id, r.first_chunk, r.title) for r in merged.collect())
    assert got == [(0, "a", 0, "new"), (0, "a", 0, "old"), (1, "a", 1, "new"), (1, "a", 2, "new"), (1, "b", 0, "old")]


def test_first_appearance_without_a_join(tables, spark):
    entity = "paper_id string, name string, type string, aliases array<string>, definition string, importance double, id string, first_chunk int, first_pos long"
    entities = spark.createDataFrame(
        [("b", "Bert", "late", [], "d", 0.5, "1", 0, 0), ("a", "bert", "early", [], "d", 0.5, "2", 3, 0), ("a", " BERT", "later", [], "d", 0.5, "3", 4, 0),
         ("a", " ", "blank", [], "d", 0.5, "4", 0, 0), ("n", "bert", "nobody", [], "d", 0.5, "5", 0, 0)], entity,
    )
    papers = spark.createDataFrame(
        [("a", 1, DAY, "A"), ("b", 1, DAY, "B"), ("n", None, DAY, "N")], "paper_id string, user_id long, created_at timestamp_ntz, title string"
    )
    found = K.entity_papers(entities, papers)
    assert scans(found) == 2  # entities and papers
    assert sorted((r.paper_id, r.first_chunk, r.name, r.type, r.title) for r in found.collect()) == [
        ("a", 3, "bert", "early", "A"), ("a", 4, "bert", "early", "A"), ("b", 0, "bert", "early", "B"),
    ]


def test_neighbours_know_the_names_of_resolved_relations(spark):
    entities = spark.createDataFrame([("e1", "one"), ("e2", "two")], "id string, name string")
    rows = [("r1", "uses", "e1", "e2", "one", "two"), ("r2", "uses", "e1", "e1", "one", "one"), ("r3", "uses", "e2", "e1", "two", "one")]
    relations = spark.createDataFrame(rows, "id string, type string, source_entity_id string, target_entity_id string, source_name string, target_name string")
    known, looked_up = Q.neighbours(entities, relations, 2), Q.neighbours(entities, relations.drop("source_name", "target_name"), 2)
    assert scans(known) == 1
    assert known.columns == looked_up.columns
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, looked_up.collect()))
