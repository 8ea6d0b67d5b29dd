import random
from collections import Counter

import pytest

from paperlake.llm import alignment as A
from paperlake.llm.alignment import align, align_papers, group_texts, links_of, load_byte_level, load_pieces, score_links

FIRST, SECOND = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def models():
    return load_byte_level(FIRST), load_pieces(SECOND)


def plain(texts):
    """Per text (n_a, n_b, groups, links) by walking over all bytes, with the two libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tokenizer, processor = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
    tokenizer.encode_special_tokens = True
    points = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter, extra = {}, 256
    for b in range(256):
        letter[chr(b) if b in points else chr(extra)] = b
        extra += b not in points
    found = []
    for text in texts:
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False)
        parts_a = [bytes(letter[c] for c in x) for x in a.tokens]
        b = processor.encode(text or "")
        parts_b = [
            bytes([int(p[3:5], 16)]) if processor.is_byte(n) else p.replace("▁", " ").encode()
            for n in b for p in [processor.id_to_piece(n)]
        ]
        data = (" " + text).encode() if text else None
        if b"".join(parts_a) != data or b"".join(parts_b) != data:
            found.append((0, 0, "", []))
            continue
        groups, links, own, other, i, j = [], [], [], [], iter(zip(a.ids, parts_a)), iter(zip(b, parts_b))
        ends_a = {sum(map(len, parts_a[: k + 1])): n for k, n in enumerate(a.ids)}
        ends_b = {sum(map(len, parts_b[: k + 1])): n for k, n in enumerate(b)}
        for at in range(1, len(data) + 1):
            if at in ends_a:
                own.append(str(ends_a[at]))
            if at in ends_b:
                other.append(str(ends_b[at]))
            if at in ends_a and at in ends_b:
                groups.append(f"{','.join(own)}|{','.join(other)}")
                links.append((ends_a[at], ends_b[at]))
                own, other = [], []
        found.append((len(a.ids), len(b), ";".join(groups), links))
    return found


def texts():
    draw = random.Random(1)
    words = "the analysis of tokenizers Größe naïve 漢字 emoji😀 3.1415 <|endoftext|> <s> x▁y internationalisation  \t\n ".split(" ")
    rows = [None, "", " ", "a", "the <|endoftext|> end", "x▁y", "<s></s><0x41>", "\n\n  two  blanks \t", "náive ​ 한국어"]
    rows += [" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(60)]
    return rows + rows[-5:]


@pytest.mark.parametrize("links", [None, 50])
def test_alignment_is_that_of_a_walk_over_bytes(spark, models, monkeypatch, links):
    if links:
        monkeypatch.setattr(A, "BLOCK_LINKS", links)
        monkeypatch.setattr(A, "SLICE", 90)
    rows = texts()
    papers = spark.createDataFrame(list(enumerate(rows)), "paper_id long, text string").repartition(3)
    aligned = align_papers(papers, *models)
    want = plain(rows)
    got = {r.paper_id: r for r in links_of(aligned).collect()}
    assert len(got) == len(rows)
    for k, (n_a, n_b, groups, pairs) in enumerate(want):
        r = got[k]
        assert (r.n_a, r.n_b, r.groups) == (n_a, n_b, groups), rows[k]
        assert r.n_groups == (groups.count(";") + 1 if groups else 0)
        assert [tuple(x) for x in r.links] == pairs
    assert want[5] == (0, 0, "", []) and want[4][0] > 0  # a mark does not come back; a special token's string does
    counts = Counter(p for w in want for p in w[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    scored = {r.paper_id: r for r in score_links(aligned).collect()}
    for k, w in enumerate(want):
        r = scored[k]
        assert (r.n_links, r.n_best, r.count_sum, r.groups) == (
            len(w[3]), sum(counts[p] == highest[p[1]] for p in w[3]), sum(counts[p] for p in w[3]), w[2]
        )


def test_tokens_without_bytes_belong_to_the_group_before_them():
    def spelt(a, b, ends_a, ends_b):
        cuts_a, cuts_b, to_a, to_b = align(a, b, ends_a, ends_b)
        return ";".join(group_texts(list(map(str, a)), list(map(str, b)), cuts_a, cuts_b)), to_a, to_b

    assert spelt([1, 2, 3], [7, 8], [2, 2, 5], [2, 5]) == ("1,2|7;3|8", [1, 2, 3], [7, 7, 8])
    assert spelt([1, 2], [7], [2, 4], [4]) == ("1,2|7", [2], [7])
    assert spelt([1], [7, 8], [3], [3, 3]) == ("1|7,8", [1, 1], [7, 8])


def test_odd_papers(spark, models, odd_papers, no_papers):
    got = score_links(align_papers(odd_papers, *models, carry=("score", "row")))
    assert got.columns == ["paper_id", "n_a", "n_b", "n_groups", "groups", "score", "row", "n_links", "n_best", "count_sum"]
    rows = got.collect()
    assert Counter(r.paper_id for r in rows) == Counter(r.paper_id for r in odd_papers.collect())
    assert all(r.n_links == r.n_groups and r.row == "r" for r in rows)
    assert all(r.n_a == r.n_links == r.count_sum == 0 and r.groups == "" for r in rows if r.paper_id in (2, 3))
    assert next(r for r in rows if r.paper_id == 5).n_a > 40000
    assert score_links(align_papers(no_papers, *models)).count() == 0


def test_parts_of_a_text_align_like_the_whole(models):
    """Cutting at blanks changes nothing, whatever stands around them."""
    draw = random.Random(7)
    marks = ["a", "Über", "don't", "x1", ".", "\n", "\t", " ", "  ", "\xa0", " ", "　", "漢", "😀", "-", "'s", "\x1c", "\u0085", "\r\n", "<|endoftext|>", "▁"]
    texts = ["".join(draw.choice(marks) + draw.choice(["", " ", " ", ""]) for _ in range(draw.randint(1, 25))) for _ in range(1500)]
    whole, cut = A.Aligner(*models), A.Aligner(*models)
    whole.split = lambda text: [text]
    assert models[0].cuts and models[1].cuts and cut.split is not whole.split
    alone = A.Aligner(*models)
    for text, (one,), parts in zip(texts, whole.parts(texts), cut.parts(texts), strict=True):
        assert [alone.parts([text])[0]] == [parts]  # parts that are new together, and one text after the other
        if one is None:
            assert None in parts, repr(text)
            continue
        joined = ";".join(x[0] for x in parts), b"".join(x[1] for x in parts), *(sum(x[k] for x in parts) for k in (2, 3, 4))
        assert one == joined, repr(text)
    assert not any(len(x) > A.KEPT_LETTERS for x in cut.kept)


def test_new_parts_are_aligned_together_and_parts_that_come_again_once(models, monkeypatch):
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzüß漢😀.,'5"
    parts = [draw.choice(" \n") + "".join(draw.choice(letters) for _ in range(draw.randint(1, 12))) for _ in range(3000)]
    aligner = A.Aligner(*models)
    one_by_one = [aligner._aligned([x], *(y.encode([x]) for y in models))[0] for x in parts]
    assert aligner._together(parts) == one_by_one
    assert aligner._together([*parts, " x▁y"]) is None and aligner.parts(["x▁y"]) == [[None]]
    # A part that stands in every slice is encoded once, however many others come between.
    monkeypatch.setattr(A, "KEPT", 4)
    seen, encode = Counter(), models[1].encode
    monkeypatch.setattr(models[1], "encode", lambda texts: seen.update(texts) or encode(texts))
    aligner = A.Aligner(*models)
    for k in range(20):
        aligner.parts([f"usual n{k} m{k}"])
    assert seen[" usual"] == 1 and len(aligner.kept) + len(aligner.older) <= 4 * 4
