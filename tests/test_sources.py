import io
import tarfile
import zipfile

import pytest

from marginalia.plans import queries as Q
from marginalia.sources import archives, corpus, sinks, tex


def paragraphs_of(spark, text):
    return tex.paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("paragraph_index").collect()


def test_blocks_have_their_places(spark):
    text = "First block here.\n\n  Second block\nof two lines.\n \nThird."
    found = tex.blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("block").collect()
    assert [r.raw for r in found] == ["First block here.", "Second block\nof two lines.", "Third."]
    assert all(text[r.start : r.end] == r.raw for r in found)


def test_places_of_very_many_blocks_and_blanks(spark):
    text = "\n" * 50_000 + "\n \n".join(f"Block é {k}\nof two lines." for k in range(50_000)) + "\n\n" + " " * 50_000
    found = tex.blocks(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n\n ")], "doc_id int, text string")).orderBy("block").collect()
    assert len(found) == 50_000 and [r.block for r in found] == list(range(50_000))
    assert all(text[r.start : r.end] == r.raw == f"Block é {r.block}\nof two lines." for r in found)


def test_one_character_block_merges_and_a_last_one_before_blanks_is_lost(spark):
    found = tex.blocks(spark.createDataFrame([(1, "A\n\nnext block of text\n\nlast one  ")], "doc_id int, text string")).collect()
    assert [r.raw for r in found] == ["A\n\nnext block of text"]


def test_headings_carry_over_short_blocks(spark):
    text = "\\section{One}\n\n\\subsection{Deep}\n\ntoo short\n\nA paragraph that is long enough.\n\n\\section{Two}\nAnother paragraph, long enough as well."
    found = paragraphs_of(spark, text)
    assert [(r.section, r.subsection, r.paragraph_id) for r in found] == [("One", "Deep", "one.par_001"), ("Two", "", "two.par_002")]


def test_more_than_999_paragraphs_keep_their_numbers(spark):
    found = paragraphs_of(spark, "\n\n".join(f"Paragraph number {k} of a long text." for k in range(1005)))
    assert found[-1].paragraph_id == "untitled.par_1005" and found[0].paragraph_id == "untitled.par_001"


def test_sentence_places(spark):
    text = "The same sentence stands here. The same sentence stands here. This one spans\na line break inside."
    rows = tex.sentences(tex.plain_paragraphs(spark.createDataFrame([(1, 1, text)], "doc_id int, paragraph_index int, text string"))).orderBy("ord").collect()
    assert [(r.char_start, r.char_end) for r in rows] == [(0, 30), (31, 61), (0, len(rows[2].text) - 1)]
    assert [r.sentence_id for r in rows] == [f"untitled.par_001.sent_00{k}" for k in (1, 2, 3)]


def test_short_sentences_leave_gaps_in_numbers_only(spark):
    text = "Short one. This sentence is certainly long enough."
    (row,) = tex.sentences(tex.plain_paragraphs(spark.createDataFrame([(1, 1, text)], "doc_id int, paragraph_index int, text string"))).collect()
    assert (row.sentence_index, row.ord) == (2, 0)


def test_includes(spark):
    files = {"main.tex": "a\\input{sub/b}c\\include{missing}d", "sub/b.tex": "[\\input{x.v1}\\input{../main}]", "sub/x.v1": "X"}
    assert tex.splice(files, "main.tex") == "[[SOURCE:main.tex]]\na[[SOURCE:sub/b.tex]]\n[[[SOURCE:sub/x.v1]]\nX]cd"


def archive(kind, names):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "text of " + n)
    else:
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for n in names:
                data = ("text of " + n).encode()
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize(("kind", "name"), [("zip", "p.zip"), ("tar", "p.tar.gz")])
def test_archives(spark, kind, name):
    content = archive(kind, ["paper/main.tex", "paper/sections/intro.tex", "paper/fig.png"])
    rows = archives.unpack_uploads(spark.createDataFrame([("u", name, bytearray(content))], "doc_id string, name string, content binary"))
    assert sorted((r.path, r.text) for r in rows.collect()) == [("paper/main.tex", "text of paper/main.tex"), ("paper/sections/intro.tex", "text of paper/sections/intro.tex")]


@pytest.mark.parametrize("member", ["../evil.tex", "/abs.tex", "a/../../evil.tex"])
@pytest.mark.parametrize(("kind", "name"), [("zip", "p.zip"), ("tar", "p.tgz")])
def test_unsafe_archives(kind, name, member):
    with pytest.raises(archives.UnsafeArchiveError):
        list(archives.members(name, archive(kind, ["ok.tex", member])))


def test_uploads_of_other_kinds():
    with pytest.raises(ValueError, match="known kind"):
        list(archives.members("a.rar", b""))
    assert list(archives.members("x/a.tex", b"t")) == [("a.tex", b"t")]
    assert archives.decoded(b"\xe9") == "é"


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").write_text("A sentence of the second source. Short. Another one that is long enough.")
    (tmp_path / "a.tex").write_text("\\emph{A sentence of the first source}.")
    (tmp_path / "sub" / "skip.md").write_text("A sentence that is not read at all.")
    rows = corpus.corpus_sentences(corpus.read_corpus(spark, str(tmp_path))).orderBy("corpus_idx").collect()
    assert [(r.corpus_idx, r.source_label, r.text) for r in rows] == [(0, "a", "A sentence of the first source."), (1, "b", "A sentence of the second source."), (2, "b", "Another one that is long enough.")]


def test_titles():
    assert sinks.title_of("a/my_draft-paper.tex") == "My Draft Paper"
    assert sinks.title_of(".tex") == "Untitled Review"


def test_numbering_in_ranges_is_the_same(spark):
    rows = spark.createDataFrame([(f"p{k * 7919 % 1000:04d}", k % 5 + 1) for k in range(1000)], "source_path string, n long").repartition(5)
    once = sorted(map(tuple, corpus.numbered(rows).collect()))
    assert sorted(map(tuple, corpus.numbered(rows, ranges=16, small=10).collect())) == once and once[0][1] == 0


def test_command_line(spark, tmp_path):
    import json

    from marginalia.__main__ import main

    (tmp_path / "in" / "paper").mkdir(parents=True)
    (tmp_path / "in" / "paper" / "main.tex").write_text("\\begin{document}\\section{A}\nThis sentence is long enough to be kept here.\\end{document}")
    (tmp_path / "lit").mkdir()
    (tmp_path / "lit" / "x.txt").write_text("This sentence is long enough to be kept here.")
    main([str(tmp_path / "in"), "--corpus", str(tmp_path / "lit"), "--out", str(tmp_path / "out")])
    (row,) = spark.read.parquet(str(tmp_path / "out" / "review")).collect()
    found = json.loads(row.payload)
    assert row.doc_id == "paper" and found["rows"][0]["matches"][0]["source_label"] == "x" and found["outline"][0]["label"] == "A" and len(found["suspicious_spans"]) == 1
    assert found["document"] == {"title": "Paper", "input_name": "paper", "sentence_count": 1, "paragraph_count": 1} and found["filters"]["sections"] == ["A"] and found["summary"]["sentence_count"] == 1 and "caveat" in found["legend"] and found["metrics"]["external_match_count"] == 1


def test_places_of_all_sentences_against_a_loop(spark, tmp_path):
    one, two, three = "The first sentence is long enough here.", "Another sentence that comes after it.", "A sentence with a line\nbreak inside of it."
    bodies = {1: f"{one} {two} {one} {three} {two}", 2: two, 3: f"{three} {one} {one}"}
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in bodies.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, sentences in ((1, [one, two, one, three, two]), (2, [two]), (3, [three, one, one])):
        cursor = 0
        for n, sentence in enumerate(x.replace("\n", " ") for x in sentences):
            start = bodies[k].find(sentence, cursor)
            start = bodies[k].find(sentence) if start < 0 else start
            cursor = max(cursor, start + len(sentence))
            want.append((k, n, max(start, 0), max(start + len(sentence), 0)))
    got = Q.QUERIES["sentence_places"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want


def test_a_lexicon_of_ones_own(spark, tmp_path):
    from marginalia.lexicons import read_phrases
    from marginalia.operators.rhetoric import phrase_hits

    (tmp_path / "l.json").write_text('{"empty_transition": ["so to say", "in a word"], "house_style": ["at our house"]}')
    (tmp_path / "bad.json").write_text('["x"]')
    rows = spark.createDataFrame([("So to say, at our house.",), ("Moreover, nothing.",)], "text string")
    got = {r.text: r for r in phrase_hits(rows, read_phrases(str(tmp_path / "l.json"))).collect()}
    assert got["So to say, at our house."].categories == ["empty_transition", "house_style"] and got["So to say, at our house."].empty_transition == 0.5
    assert got["Moreover, nothing."].phrases == []
    assert phrase_hits(rows, {}).first().phrases == []
    with pytest.raises(ValueError, match="lists of phrases"):
        read_phrases(str(tmp_path / "bad.json"))


def test_uploads_that_are_refused(spark, tmp_path, monkeypatch):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "paper.tex").write_text(f"text of {folder}")
    (tmp_path / "b" / "notes.doc").write_text("x")
    with pytest.raises(ValueError, match="notes.doc"):
        archives.read_uploads(spark, str(tmp_path))
    got = archives.unpack_uploads(archives.read_uploads(spark, str(tmp_path), skip_refused=True)).collect()
    assert sorted((r.path, r.text) for r in got) == [("paper.tex", "text of a"), ("paper.tex", "text of b")] and len({r.doc_id for r in got}) == 2
    monkeypatch.setattr(archives, "MAX_BYTES", 3)
    assert archives.refused_uploads(spark, str(tmp_path)).count() == 3
    monkeypatch.setattr(archives, "MAX_BYTES", 1 << 20)
    monkeypatch.setattr(archives, "MAX_UNPACKED", 10)
    blob = __import__("io").BytesIO()
    with __import__("zipfile").ZipFile(blob, "w") as z:
        z.writestr("a.tex", "x" * 11)
    with pytest.raises(ValueError, match="10 bytes"):
        list(archives.members("z.zip", blob.getvalue()))
