import pytest
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "ends"),
    [
        ("We use a new model. Next one here.", True),
        ("我们在这里使用一个新的模型。下一个句子在这里，它也足够长。", True),
        ("The value is 3.14 in all the runs", False),
        ("Many things, e.g.x and more of it", False),
        ("Shown by Smith et al. and others here", False),
        ("As one sees in Fig. 3 of the paper", False),
        ("By Eq. 4 the rest follows from it", False),
        ("That is i.e. something like this", False),
        ("Written by J. Smith in the last year", False),
        ("Wait for it.. and then go on again", False),
        ("It really works! And then some more text", True),
    ],
)
def test_sentence_ends(spark, text, ends):
    assert len(one(spark, T.sentence_array(F.col("t")), t=text)) == (2 if ends else 1)


def test_lines_merge_without_blank_in_cjk(spark):
    text = "我们提出了一种新的方法，\n在多个数据集上取得了更高的准确率。\n这个结果说明模型可以稳定泛化。"
    assert one(spark, T.sentence_array(T.unwrap(F.col("t"))), t=text) == [
        "我们提出了一种新的方法，在多个数据集上取得了更高的准确率。",
        "这个结果说明模型可以稳定泛化。",
    ]
    assert one(spark, T.unwrap(F.col("t")), t="a\nb\nc-\nd\n1\n\n2") == "a b c-d 1 2"


def python_sentences(text):
    """Character-by-character reading of the rules."""
    out, current = [], ""
    for i, ch in enumerate(text):
        current += ch
        after = text[i + 1] if i + 1 < len(text) else ""
        end = ch in T.SENTENCE_ENDS
        if ch == "." and (not after or after.isspace()):
            run = len(current) - 1
            while run > 0 and (current[run - 1].isalpha() or current[run - 1] == "."):
                run -= 1
            word = current[run:-1]
            end = not ("." in word or (len(word) == 1 and word.isalpha()) or word.lower() in T.ABBREVIATIONS)
        if end:
            out.append(current)
            current = ""
    cleaned = [" ".join(s.split()) for s in [*out, current]]
    return [s for s in cleaned if len(s) >= 12]


def python_chunks(lengths, max_chars, max_items):
    number, chars, items, out = 0, 0, 0, []
    for n in lengths:
        if items and (chars + n > max_chars or items >= max_items):
            number, chars, items = number + 1, 0, 0
        chars, items = chars + n, items + 1
        out.append(number)
    return out


TRICKY = (
    "Dr. A. Smith et al. wrote e.g.this. See Fig. 2. The U.S. case;it is odd… A..B. c.d. e.  Next one.\n\n"
    "Is it so?Yes it is! 价格是3.5元。很好；对. x.\ny z.. Vol. 3 No. 4 pp. 5 ends here. no. vs. The end of all this"
)


def test_sentences_and_chunks_equal_plain_folds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, TRICKY), (-2, ""), (-3, " . . ")], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in T.pack_chunks(docs, max_chars=900, max_items=7).collect():
        got.setdefault(r.doc_id, []).append((int(r.sentence_id.split("_s")[1]), r.text, r.chunk_no))
    for doc, text in texts.items():
        want = python_sentences(text)
        rows = sorted(got.get(doc, []))
        assert [r[1] for r in rows] == want, doc
        assert [r[0] for r in rows] == list(range(1, len(want) + 1))
        assert [r[2] for r in rows] == python_chunks([len(s) for s in want], 900, 7), doc


def test_chunks_span_pages(spark):
    pages = spark.createDataFrame(
        [("d", 1, "Second page sentence."), ("d", 0, "First page sentence. And one more of it.")], "doc string, page int, text string"
    )
    rows = sorted(T.pack_chunks(pages, "doc", "text", "page", max_items=2).collect(), key=lambda r: r.sentence_id)
    assert [(r.sentence_id, r.chunk_no) for r in rows] == [("p1_s1", 0), ("p1_s2", 0), ("p2_s1", 1)]


def chunks(spark, text, titles):
    texts = spark.createDataFrame([("p", text)], "paper_id string, text string")
    sections = spark.createDataFrame([("p", i, t) for i, t in enumerate(titles)], "paper_id string, section_no int, title string")
    return (
        [r.text for r in T.split_sections(texts, sections).orderBy("chunk_no").collect()],
        [r.text for r in T.select_chunks(texts, sections).orderBy("chunk_no").collect()],
    )


def test_sections_keep_preamble(spark):
    text = "intro " * 30 + "METHODS " + "m " * 100 + "RESULTS " + "r " * 100
    parts, kept = chunks(spark, text, ["Methods", "Results", "Missing"])
    assert "".join(parts) == text and parts[0] == "intro " * 30 and len(parts) == 3 and kept == parts


def test_sections_fall_back_to_slices_or_whole(spark):
    text = "abcde fghij " * 900
    parts, _ = chunks(spark, text, ["nothing", "here"])
    assert "".join(parts) == text and {len(p) for p in parts[:-1]} == {2000}
    assert chunks(spark, text, [])[0] == [text]
    assert chunks(spark, "x" * 50, [])[1] == ["x" * 50]
    # An empty title matches the start, and equal positions give an empty chunk.
    assert chunks(spark, "one two", ["", "one", "two"])[0] == ["", "one ", "two"]


def test_budget(spark):
    text = "h" * 15000 + "t" * 10000
    assert one(spark, T.budget(F.col("t")), t=text) == text[:12000] + T.OMISSION + text[-8000:]
    assert one(spark, T.budget(F.col("t")), t="short") == "short"


def test_keys_and_names(spark):
    assert one(spark, X.key_nfkc(F.col("t")), t="  BERT  ") == one(spark, X.key_nfkc(F.col("t")), t="ＢＥＲＴ") == "bert"
    assert one(spark, X.key_nfkc(F.col("t")), t="Straße　ﬁne") == "strasse fine"
    names = {"[CLS] token": "CLS token", "model#1": "model 1", "F1-score": "F1-score", "a/b\\c": "a_b_c", " .. ": "Untitled", "__x__": "x"}
    for raw, clean in names.items():
        assert one(spark, X.sanitize_name(F.col("t")), t=raw) == clean
    assert one(spark, X.safe_filename(F.col("t")), t='a<b>:"/\\|?*c ') == "a_b________c"
    assert one(spark, X.normalize_tags(F.col("t")), t="reading, ,important ") == ["reading", "important"]


def test_escapes(spark):
    assert one(spark, X.yaml_quote(F.col("t")), t='a "b" \\ c') == '"a \\"b\\" \\\\ c"'
    assert one(spark, X.bibtex_escape(F.col("t")), t="50% & {x}_#$~^") == (
        r"50\% \& \{x\}\_\#\$\textasciitilde\{\}\textasciicircum{}".replace("tilde\\{\\}", "tilde{}")
    )
    assert one(spark, X.bibtex_escape(F.col("t")), t="\\") == r"\textbackslash\{\}"
    assert one(spark, X.cite_key(F.col("t")), t="a b{c}:1") == "abc:1"
    assert one(spark, X.cite_key(F.col("t")), t="{}") == "ref"
    assert tuple(one(spark, X.split_name(F.col("t")), t=" Ada  B. Byron ")) == ("Ada B.", "Byron")
    assert tuple(one(spark, X.split_name(F.col("t")), t="Cher")) == ("Cher", "")
    assert one(spark, X.title_case(F.col("t")), t="main_result-x y") == "Main_Result-X Y"
