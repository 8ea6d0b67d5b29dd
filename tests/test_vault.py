"""Notes as files, the mapping table in buckets, and search through an index."""

import io
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from paperlake.operators import knowledge as W
from paperlake.operators import lifecycle as M
from paperlake.operators import queries as Q
from paperlake.operators.search import TextIndex
from paperlake.plans.bindings import now
from paperlake.sources import dictionary as D
from paperlake.sources import files as S
from paperlake.sources import mapping as K
from paperlake.sources.buckets import bucket_of
from paperlake.sources import note_files as N

NOTE = "relative_path string, content string"


def tree(root):
    return {
        os.path.relpath(os.path.join(folder, name), root): open(os.path.join(folder, name), encoding="utf-8", newline="").read()
        for folder, _, names in os.walk(root) for name in names
    }


def notes_of(spark, rows):
    return spark.createDataFrame(rows, NOTE).repartition(4)


def test_notes_are_published_together(spark, tmp_path):
    vault = str(tmp_path / "my vault")
    first = {f"7/papers/Note {k}%.md": f"---\nid: {k}\n---\nText ä {k}\r\n" for k in range(20)} | {"_x.md": "", "e/.y.md": "z"}
    N.write_note_files(notes_of(spark, list(first.items())), vault)
    assert tree(vault) == first and os.listdir(tmp_path) == ["my vault"]
    second = {"7/papers/Note 1%.md": "new", "8/papers/A.md": "a"}
    N.write_note_files(notes_of(spark, list(second.items())), vault, replace=False)
    assert tree(vault) == first | second and os.listdir(tmp_path) == ["my vault"]
    N.write_note_files(notes_of(spark, list(second.items())), f"file://{vault}")
    assert tree(vault) == second and os.listdir(tmp_path) == ["my vault"]


@pytest.mark.parametrize("bad", [("../out.md", "x"), ("/etc/x.md", "x"), ("a//b.md", "x"), ("ok.md", None)])
def test_a_failing_task_leaves_nothing(spark, tmp_path, bad):
    vault = str(tmp_path / "vault")
    N.write_note_files(notes_of(spark, [("a.md", "old")]), vault)
    for replace in (True, False):
        with pytest.raises(Exception):
            N.write_note_files(notes_of(spark, [(f"n{k}.md", "new") for k in range(9)] + [bad]), vault, replace)
        assert tree(vault) == {"a.md": "old"} and os.listdir(tmp_path) == ["vault"]


def test_what_a_job_left_is_taken_up(spark, tmp_path):
    vault = tmp_path / "vault"
    done, open_, swap = (tmp_path / f".vault.notes-{k}" for k in ("1", "2", "3"))
    for folder in (done / "tree/p", done / "manifest", open_ / "tree"):
        folder.mkdir(parents=True)
    (done / "tree/p/a.md").write_text("new")
    (done / "tree/stray.md").write_text("of an attempt that failed")
    (done / "manifest/m1").write_text('"p/a.md"\n"p/moved before.md"\n')
    (done / "manifest/m2").write_text('"stray.md"\n')
    (done / "committed").write_text("m1\n")
    (open_ / "tree/b.md").write_text("never committed")
    N.publish(spark, str(vault))
    assert tree(vault) == {"p/a.md": "new"} and os.listdir(tmp_path) == ["vault"]
    # An exchange that was ended between its two renames.
    swap.mkdir()
    os.rename(vault, swap / "old")
    (swap / "tree").mkdir()
    (swap / "tree/c.md").write_text("c")
    N.publish(spark, str(vault))
    assert tree(vault) == {"c.md": "c"} and os.listdir(tmp_path) == ["vault"]


class Counted(io.BytesIO):
    def read(self, n=-1):
        data = super().read(n)
        self.taken = getattr(self, "taken", 0) + len(data)
        return data


def test_heads_do_not_read_bodies(spark, tmp_path):
    body = "x" * 1_000_000
    for text, most in ((f"---\na: b\n---\n{body}", N.STEP), (body, N.STEP), ("---\na: " + "y" * 9000 + f"\n---\n{body}", 3 * N.STEP)):
        stream = Counted(text.encode())
        head = N.head_of(stream)
        assert stream.taken <= most and (not head or head.endswith(b"---"))
    rows = [
        ("Papers/a b+%41.md", '---\nlake_type: "paper"\nlake_id: "a \\"q\\""\nlake_id: last\nlake_type: "paper"\n---\n' + body),
        (".hidden/x.md", "---\na: b\n---\n"), ("Papers/none.md", "text"), ("Papers/open.md", "---\na: b\n"), ("x.txt", "---\na: b\n---\n"),
    ]
    vault = str(tmp_path / "vault")
    N.write_note_files(notes_of(spark, rows), vault)
    want = {"Papers/a b+%41.md": {"lake_type": "paper", "lake_id": "last"}, "Papers/none.md": {}, "Papers/open.md": {}}
    for read in (N.read_note_heads, S.read_notes):
        assert {r.relative_path: r.front_matter for r in read(spark, vault).collect()} == want


def test_heads_are_read_by_few_tasks(spark, tmp_path):
    """Many small notes, in one folder or in many, take no more tasks than the session deals rows to."""
    vault = tmp_path / "vault"
    names = [f"{k % 20}/papers/n{k}.md" for k in range(100)] + [f"all/n{k}.md" for k in range(100)] + ["top.md", "9/deep/er/n.md"]
    for name in [*names, "_out/n.md", "1/.off/n.md", "1/papers/_n.md", "1/papers/n.txt"]:
        (vault / name).parent.mkdir(parents=True, exist_ok=True)
        (vault / name).write_text(f"---\nname: {name}\n---\n")
    (vault / "empty.md").write_text("")
    found = N.read_note_heads(spark, f"file://{vault}/")
    assert {r.relative_path: r.front_matter.get("name") for r in found.collect()} == {n: n for n in names}
    assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    # As many as a plain read of the files finds.
    assert {r.relative_path for r in S.read_notes(spark, str(vault)).collect()} == set(names)
    with pytest.raises(Exception, match="nowhere"):
        N.read_note_heads(spark, str(tmp_path / "nowhere")).collect()


def test_long_front_matter_is_linear(spark):
    lines = "\n".join(f"key{k % 5000}: {k}" for k in range(20_000))
    note = spark.createDataFrame([(f"---\n{lines}\n---\n",)], "t string")
    found = note.select(S.front_matter(F.col("t")).alias("m")).first().m
    assert len(found) == 5000 and found["key0"] == "15000" and found["key4999"] == "19999"


MAPPING = ["mapping_id", "user_id", "paper_id", "item_type", "item_id", "normalized_key", "source_name", "vault_path", "relative_path", "content_hash"]
MAPPING_DDL = ", ".join(f"{k} {'long' if k == 'user_id' else 'string'}" for k in MAPPING)


def mapped(spark, rows):
    return spark.createDataFrame([(i, 1, i, "paper", i, i, i, "/v", f"P/{i}.md", h) for i, h in rows], MAPPING_DDL)


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "mapping")
    files = spark.createDataFrame([("/v", f"P/m{k}.md") for k in range(0, 200, 2)], "vault_path string, relative_path string")
    old = mapped(spark, [(f"m{k}", "h") for k in range(200)])
    planned = K.upsert_notes(old, path, files, now("2024-01-01 00:00:00"), buckets=16)
    assert planned.count() == 200 and {r.state for r in planned.collect()} == {"written"}
    before = {p for p in tree_names(path)}
    new = mapped(spark, [("m4", "h"), ("m6", "h2"), ("m5", "h"), ("n1", "h")])
    planned = K.upsert_notes(new, path, files, now(), buckets=16)
    assert {r.mapping_id: r.state for r in planned.collect()} == {"m4": "skipped", "m6": "written", "m5": "written", "n1": "written"}
    touched = {r.b for r in new.select(bucket_of("mapping_id", buckets=16).alias("b")).collect()}
    after = tree_names(path)
    kept = {p for p in before if int(p.split("/")[0].removeprefix("bucket=")) not in touched}
    assert kept and kept <= after and not (before - kept) & after
    whole = M.plan_notes(new, old.withColumn("updated_at", now("2024-01-01 00:00:00")), files, now()).drop("state")
    state = K.read_mapping(spark, path)
    rows = lambda df: {r.mapping_id: (r.content_hash, r.relative_path) for r in df.collect()}
    assert rows(state) == rows(whole) and state.count() == 201
    times = {r.mapping_id: r.updated_at for r in state.collect()}
    assert {r.mapping_id: r.updated_at for r in whole.collect() if r.mapping_id in ("m4", "m6", "n1", "m7")}.items() <= times.items()
    assert K.upsert_notes(new.limit(0), path, files, now(), buckets=16).isEmpty() and tree_names(path) == after
    assert K.read_mapping(spark, str(tmp_path / "none")).isEmpty()


def tree_names(root):
    return {p for p in tree_paths(root) if p.endswith(".parquet")}


def tree_paths(root):
    return [os.path.relpath(os.path.join(folder, name), root) for folder, _, names in os.walk(root) for name in names]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    draw = random.Random(6)
    names = ["", "a", "ab", "%_", "Ünï Çode", "漢字かな", None, "The BERT", "bert", "Transformer/BERT"] + [
        "".join(draw.choice("abC 1é") for _ in range(draw.randint(1, 14))) for _ in range(300)
    ]
    rows = spark.createDataFrame([(k, n, f"x{k}") for k, n in enumerate(names * 2)], "id long, name string, gram string")
    index = TextIndex(spark, str(tmp_path / "index"), "name", buckets=8)
    index.build(rows)
    fragments = ["a", "B", "é", "ab", "c ", "BERT", "abc", "1é", "aba", "字か", "ï ç", "%", "_", "no such", "abcabcabc", "bertx", "aaaa"]
    for text in fragments + [names[20], names[30][:5]]:
        got = sorted(map(tuple, index.search(text).collect()))
        assert got == sorted(map(tuple, Q.search(rows, "name", text).collect())), text
    assert index.search("").count() == rows.filter("name IS NOT NULL").count()
    plan = index.texts("bert")._jdf.queryExecution().executedPlan().toString()
    (filters,) = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert "_bucket" in filters
    read = {x.split("_bucket=")[1].split("/")[0] for x in index.texts("bert").inputFiles()}
    assert len(read) <= 8 and len(index._buckets_of(["ber", "ert"])) <= 2


def test_merged_halves_are_the_whole(spark, tmp_path):
    draw = random.Random(2)
    papers = spark.createDataFrame(
        [(f"p{k}", k % 2, f"T{k}", draw.randint(1, 28)) for k in range(20)], "paper_id string, user_id long, title string, day int"
    ).withColumn("created_at", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("day"), F.lit(0), F.lit(0), F.lit(0)))
    rows = [
        (f"p{draw.randint(0, 19)}", draw.randint(0, 2), k, draw.choice(["BERT", " bert ", "GPT", "Hot", "", "x%d" % draw.randint(0, 9)]), f"d{k}")
        for k in range(200)
    ]
    entities = spark.createDataFrame(rows, "paper_id string, first_chunk int, first_pos int, name string, definition string").withColumns(
        {"type": F.lit("t"), "aliases": F.array(F.lit("a")), "importance": F.lit(0.5), "id": F.concat(F.lit("e"), "first_pos")}
    )
    path = str(tmp_path / "dictionary")
    part = F.pmod(F.xxhash64("paper_id"), F.lit(3))
    for k in (2, 0, 1, 0):  # in any order, one of them twice
        D.merge_papers(entities.filter(part == k), papers, path, buckets=8)
    whole = W.global_entities(entities, papers)
    key = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    columns = ["user_id", "entity_key", "name", "definition", "id", "paper_id"]
    assert key(D.dictionary(spark, path), *columns) == key(whole, *columns)
    columns = ["user_id", "entity_key", "name", "definition", "paper_id", "title", "first_pos"]
    assert key(D.papers_of_entities(spark, path), *columns) == key(W.entity_papers(entities, papers), *columns)
    before = tree_names(path)
    D.merge_papers(entities.filter("name = 'Hot'"), papers, path, buckets=8)
    assert len(before & tree_names(path)) > len(before) / 3  # most buckets have no such key


def test_versions_are_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, 2.5)], "id int, price float").write.parquet(f"{tmp_path}/t/version=1")
    spark.createDataFrame([(2, 3.5, "m")], "id long, price double, mode string").write.parquet(f"{tmp_path}/t/version=2")
    spark.createDataFrame([(3, None, None, True)], "id long, price double, mode string, highlight boolean").write.parquet(f"{tmp_path}/t/version=3")
    table = S.read_versions(
        spark, f"{tmp_path}/t", "id BIGINT, mode STRING, price DOUBLE, highlight BOOLEAN",
        {1: {"mode": "translate", "highlight": False}, 2: {"highlight": False}},
    )
    assert sorted(map(tuple, table.collect())) == [(1, "translate", 2.5, False, 1), (2, "m", 3.5, False, 2), (3, None, None, True, 3)]
    assert table._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert len(table.filter("version = 2").inputFiles()) >= 1 and table.filter("version = 2").count() == 1
