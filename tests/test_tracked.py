"""Edits as rows, against a plain model of a document, and packages that keep what edits don't touch."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import diff, edits, links, search, tracked
from inkloom.sources import docx

from .test_documents import PARTS, package

EDITS = "doc_id string, seq int, type string, find string, replace string, text string, after string, before string, occurrence string, regex boolean, scope string, ref string, author string"


def edit(doc_id, seq, kind, **given):
    names = [c.split()[0] for c in EDITS.split(", ")[3:]]
    assert set(given) <= set(names)
    return (doc_id, seq, kind, *(given.get(n) for n in names))


def texts(runs, column="text"):
    rows = sorted(((r.part, r.p_idx, r.r_idx, r[column] or "") for r in runs.collect()))
    out = {}
    for part, p, _, t in rows:
        out[part, p] = out.get((part, p), "") + t
    return out


@pytest.fixture(scope="module")
def found(spark):
    df = docx.entities(spark.createDataFrame([("a", package())], "doc_id string, content binary")).cache()
    yield lambda kind: docx.entity(df, kind)
    df.unpersist()


TODO = [
    edit("a", 1, "replace_tracked", find="plain green", replace="slow red"),
    edit("a", 2, "insert_tracked", text=" very", after="slow"),
    edit("a", 3, "delete", find="other"),
    edit("a", 4, "move_tracked", find="owl cell", after="red"),
    edit("a", 5, "format_tracked", find="Introd", replace="bold"),
    edit("a", 6, "replace_tracked", find="use(d)", replace="\\1-x", regex=True, scope="footnotes", author="Zed"),
    edit("a", 7, "delete", find="nothing such"),
    edit("a", 8, "replace", find="Top", replace="Head", scope="headers"),
    edit("a", 9, "delete", find="bold", ref="p:0"),
]


@pytest.fixture(scope="module")
def edited(spark, found):
    after, changes, results = tracked.apply(found("runs"), spark.createDataFrame(TODO, EDITS), changes=found("changes"))
    return after.cache(), changes.cache(), results


def test_rounds(edited):
    after, changes, results = edited
    assert {r.seq: r.success for r in results.collect()} == {1: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False, 8: True, 9: False}
    body = texts(after.where("part = 'word/document.xml'"))
    assert body[tracked.BODY, 1] == "The slow very redowl cell owl" and body[tracked.BODY, 3] == ""
    assert (tracked.BODY, 4) not in body
    assert texts(after)["word/footnotes.xml", 1] == " d-x" and texts(after)["word/header1.xml", 0] == "Head"
    rows = {(r.change_id, r.change_type, r.author, r.text) for r in changes.collect()}
    assert {("5", "deletion", "Inkloom", "plain green"), ("6", "insertion", "Inkloom", "slow red"), ("12", "insertion", "Zed", "d-x")} <= rows
    ids = [r.change_id for r in changes.collect()]
    assert len(set(ids)) == len(ids) == 8 and not {"2", "3", "4"} & set(ids)


def test_saved_package_keeps_the_rest(spark, found, edited):
    before = package()
    saved = docx.saved(spark.createDataFrame([("a", before), ("b", before), ("none", None)], "doc_id string, content binary"), tracked.changed_paragraphs(edited[0], found("runs")))
    out = {r.doc_id: r.content for r in saved.collect()}
    assert bytes(out["b"]) == before and out["none"] is None
    old, new = zipfile.ZipFile(io.BytesIO(before)), zipfile.ZipFile(io.BytesIO(bytes(out["a"])))
    assert new.namelist() == old.namelist()
    assert {n for n in new.namelist() if new.read(n) != old.read(n)} == {"word/document.xml", "word/footnotes.xml", "word/header1.xml"}
    xml = new.read("word/document.xml").decode()
    for kept in ("bookmarkStart", "commentRangeStart", "footnoteReference", "<w:tbl>", "instrText", 'w:author="Mira"', 'w:author="Ines"', "hyperlink"):
        assert kept in xml
    again = docx.entities(saved.where("doc_id = 'a'"))
    assert texts(docx.entity(again, "runs"))[tracked.BODY, 1] == "The slow very redowl cell owl"
    kinds = [(r.change_id, r.change_type) for r in docx.entity(again, "changes").collect()]
    assert {("5", "deletion"), ("6", "insertion"), ("8", "move_to"), ("9", "move_from"), ("2", "insertion"), ("3", "deletion"), ("4", "format_run")} <= set(kinds)


@pytest.mark.parametrize("seed", range(3))
def test_against_a_model(spark, seed):
    """Replacements, deletions and insertions over random runs: what is visible after, and what was before."""
    rng = random.Random(seed)
    runs, plain, rows, want = [], {}, [], {}
    for d in range(12):
        doc = [[("".join(rng.choice("ab ") for _ in range(rng.randrange(5)))) for _ in range(rng.randrange(1, 5))] for _ in range(3)]
        runs += [(str(d), tracked.BODY, p, r, t, "", False, False) for p, line in enumerate(doc) for r, t in enumerate(line)]
        lines = plain[d] = ["".join(line) for line in doc]
        lines = list(lines)
        for seq in range(3):
            kind, find, new, which = rng.choice(["replace", "delete", "insert"]), rng.choice(["a", "ab", "b a"]), rng.choice(["X", "abab", ""]), rng.choice(["first", "last", "all", "2"])
            rows.append(edit(str(d), seq, kind, **({"find": find, "replace": new} if kind == "replace" else {"find": find} if kind == "delete" else {"after": find, "text": new}), occurrence=which))
            places = []
            for p, line in enumerate(lines):
                at = 0
                while (at := line.find(find, at)) >= 0:
                    places.append((p, at))
                    at += len(find)
            picked = places if which == "all" else places[:1] if which == "first" else places[-1:] if which == "last" else places[1:2]
            for p, at in reversed(picked):
                end = at + len(find)
                lines[p] = lines[p][:at] + {"replace": new, "delete": "", "insert": find + new}[kind] + lines[p][end:]
        want |= {(str(d), p): t for p, t in enumerate(lines)}
    df = spark.createDataFrame(runs, "doc_id string, part string, p_idx int, r_idx int, text string, del_text string, in_ins boolean, in_del boolean")
    for track in (False, True):
        after = tracked.apply(df, spark.createDataFrame(rows, EDITS).withColumn("track", F.lit(track)))[0]
        seen = {(r.doc_id, r.p_idx): r.text for r in tracked.visible(after).collect()}
        assert {k: seen.get(k, "") for k in want} == want
        if track:  # without insertions and with deletions back, all is as it was
            old = after.where("not in_ins").withColumn("text", F.concat("text", F.coalesce("del_text", F.lit(""))))
            back = {(r.doc_id, r.p_idx): r.text for r in tracked.visible(old).collect()}
            assert all(back.get((str(d), p), "") == t for d, lines in plain.items() for p, t in enumerate(lines))


def test_no_edits(spark, found):
    runs = found("runs")
    after, changes, results = tracked.apply(runs, spark.createDataFrame([], EDITS))
    assert after.count() == runs.count() and changes.count() == results.count() == 0


def test_entities_of_parts_stay_apart(spark):
    """A bookmark, a link and a note reference in the body and in a header, each the first of its part."""
    mark = '<w:p><w:bookmarkStart w:id="{n}" w:name="{name}"/><w:hyperlink w:anchor="{name}"><w:r><w:t>{name}</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="{n}"/></w:r></w:p>'
    ns = PARTS["word/document.xml"].split("<w:document ")[1].split(">")[0]
    parts = PARTS | {"word/document.xml": f"<w:document {ns}><w:body>{mark.format(n=2, name='here')}</w:body></w:document>", "word/header1.xml": f"<w:hdr {ns}>{mark.format(n=3, name='top')}</w:hdr>"}
    df = docx.entities(spark.createDataFrame([("a", package(parts))], "doc_id string, content binary"))
    for kind, column in (("bookmarks", "name"), ("hyperlinks", "anchor"), ("note_refs", "note_id")):
        got = {(r.part, r.p_idx): r[column] for r in docx.entity(df, kind).collect()}
        assert got == dict(zip([("word/document.xml", 0), ("word/header1.xml", 0)], ("2", "3") if kind == "note_refs" else ("here", "top"), strict=True))
    assert {r.note_id: r.text for r in docx.entity(df, "paragraphs").where("part = 'word/footnotes.xml' and text <> ''").collect()} == {"2": " used", "3": "unused"}
    comments = spark.createDataFrame([("a", "word/header1.xml", "0", 0)], "doc_id string, part string, comment_id string, start_p_idx int")
    lines = docx.entity(df, "paragraphs")
    assert links.filter_comments(comments, lines, scope=F.col("text") == "top").count() == 1 and links.filter_comments(comments, lines, scope=F.col("text") == "here").count() == 0


def test_viability(found):
    got = {r.p_idx: r.reason for r in diff.viability(found("paragraphs").where("part = 'word/document.xml'")).collect()}
    assert got == {0: None, 1: "paragraph has tracked changes", 2: "paragraph has tracked changes", 3: None, 4: None, 5: "paragraph has fields, links or content controls"}


def test_case_folding_keeps_places(spark):
    p = spark.createDataFrame([(1, 0, "İstanbul THE end the"), (1, 1, "the"), (1, 2, "thethe İTHE")], "doc_id long, p_idx int, text string")
    got = [(r.p_idx, r.pos, r.found) for r in search.find_all(p, "the", case_sensitive=False).orderBy("p_idx", "pos").collect()]
    assert got == [(0, 9, "THE"), (0, 17, "the"), (1, 0, "the"), (2, 0, "the"), (2, 3, "the"), (2, 8, "THE")]
    assert [(r.pos, r.found) for r in search.find_all(p, "t.e", regex=True).orderBy("p_idx", "pos").collect()] == [(17, "the"), (0, "the"), (0, "the"), (3, "the")]
    odd = spark.createDataFrame([(1, 0, "a “b” \\E c"), (1, 1, "aaa")], "doc_id long, p_idx int, text string")
    assert [(r.pos, r.found) for r in search.find_all(odd, '"b"', normalize=True).collect()] == [(2, "“b”")]
    assert [r.pos for r in search.find_all(odd, "\\E").collect()] == [6] and sorted(r.pos for r in search.find_all(odd, "aa").collect()) == [0, 1]


def test_disjoint_edits_that_meet_fail(spark):
    p = spark.createDataFrame([(1, 0, "a b"), (1, 1, "b")], "doc_id long, p_idx int, text string")
    two = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "doc_id long, find string, replace string")
    with pytest.raises(Exception, match="edits meet"):
        edits.apply_disjoint(p, two).collect()
    assert {r.text for r in edits.apply_disjoint(p, two.where("find = 'b'"), track=False).collect()} == {"a y", "y"}


def test_properties_merge(spark):
    row = spark.sql("select map('bold', 'true', 'color', 'red') as a, map('bold', 'false', 'italic', 'true', 'color', null) as b")
    assert row.select(T.merge_properties(F.col("a"), F.col("b")).alias("m")).head().m == {"color": "red", "italic": "true"}


def plain_runs(spark, docs):
    """Documents given as lists of paragraphs, each a list of run texts."""
    rows = [(d, tracked.BODY, p, r, t, "", False, False) for d, doc in docs.items() for p, line in enumerate(doc) for r, t in enumerate(line)]
    return spark.createDataFrame(rows, "doc_id string, part string, p_idx int, r_idx int, text string, del_text string, in_ins boolean, in_del boolean")


def counted_rounds(monkeypatch):
    rounds, inner = [], tracked._round
    monkeypatch.setattr(tracked, "_round", lambda *a: rounds.append(1) or inner(*a))
    return rounds


def test_disjoint_edits_take_one_round(spark, monkeypatch):
    """Fifty edits of one document, of them twenty in one paragraph; then some that must see what others left."""
    words = [f"word{i:02}" for i in range(50)]
    docs = {"a": [[" ".join(words[:20])], *([f"start {w} end"] for w in words[20:])], "b": [["one two"]]}
    todo = [edit("a", i, ("replace_tracked", "delete", "format_tracked", "replace")[i % 4], find=w, replace=f"new{i}" if i % 4 != 2 else "bold") for i, w in enumerate(words)]
    rounds = counted_rounds(monkeypatch)
    after, made, results = tracked.apply(plain_runs(spark, docs), spark.createDataFrame([*todo, edit("b", 1, "delete", find="two")], EDITS))
    assert len(rounds) == 1 and all(r.success for r in results.collect()) and results.count() == 51
    want = [f"new{i}" if i % 4 in (0, 3) else "" if i % 4 == 1 else w for i, w in enumerate(words)]
    assert texts(after.where("doc_id = 'a'"))[tracked.BODY, 0].split(" ") == want[:20]
    ids = [int(r.change_id) for r in made.collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    rounds.clear()
    chain = [edit("a", 1, "replace", find="word01", replace="mid"), edit("a", 2, "replace", find="mid", replace="far"), edit("a", 3, "delete", find="word30"), edit("a", 4, "delete", find="farword"), edit("b", 1, "delete", find="one")]
    after, _, results = tracked.apply(plain_runs(spark, docs), spark.createDataFrame(chain, EDITS))
    assert len(rounds) == 2 and {r.seq: r.success for r in results.where("doc_id = 'a'").collect()} == {1: True, 2: True, 3: True, 4: False}
    assert texts(after.where("doc_id = 'a'"))[tracked.BODY, 0].startswith("word00 far word02")


def random_batch(seed):
    rng = random.Random(seed)
    docs, rows = {}, []
    for d in range(14):
        docs[str(d)] = [[("".join(rng.choice("ab c") for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(1, 4))] for _ in range(3)]
        for seq in range(1, 6):
            kind = rng.choice(["replace", "delete", "insert", "move", "format"]) + rng.choice(["", "_tracked"])
            find, new, other = (rng.choice(["a", "ab", "b a", "c", "bab", "a c", "aba"]) for _ in range(3))
            given = {"replace": {"find": find, "replace": new}, "delete": {"text": find}, "insert": {rng.choice(["after", "before"]): find, "text": new}, "format": {"find": find, "replace": rng.choice(["bold", "italic"])}, "move": {"text": find, "after": other}}[kind.split("_")[0]]
            if kind.startswith("replace") and rng.random() < 0.3:
                given = {"find": rng.choice(["a(b)", "(?<=a)b", "c.", "b+", "("]), "replace": rng.choice(["$\\1" if rng.random() < 0.5 else "x", "\\\\", "$5.00"]), "regex": True}
                given["replace"] = given["replace"] if "(b)" in given["find"] else given["replace"].replace("\\1", "z")
            if rng.random() < 0.15:
                given["scope"] = rng.choice(["c", "paragraph_containing:ab"])
            if rng.random() < 0.1:
                given["ref"] = f"p:{rng.randrange(3)}"
            rows.append(edit(str(d), seq, kind, occurrence=rng.choice(["first", "last", "all", "2", "[1, 2]", None]), **given))
    return docs, rows


@pytest.mark.parametrize("seed", range(2))
def test_a_batch_is_like_its_edits_one_by_one(spark, monkeypatch, seed):
    docs, rows = random_batch(seed)
    runs = plain_runs(spark, docs)
    rounds = counted_rounds(monkeypatch)
    after, made, results = (x.collect() for x in tracked.apply(runs, spark.createDataFrame(rows, EDITS)))
    n = len(rounds)
    now, change_rows, said = runs, [], []
    for seq in range(1, 6):
        known = spark.createDataFrame([(r.doc_id, r.change_id) for r in change_rows], "doc_id string, change_id string")
        now, new, told = tracked.apply(now, spark.createDataFrame([r for r in rows if r[1] == seq], EDITS), changes=known)
        change_rows += new.collect()
        said += told.collect()
    columns = ["doc_id", "p_idx", "r_idx", "text", "del_text", "in_ins", "in_del", "change_id", "author", "bold", "italic", "fresh", "mark", "formatted", "same"]
    plain = lambda some, names: sorted(repr(tuple(r[c] for c in names)) for r in some)
    assert plain(results, ["doc_id", "seq", "success", "message"]) == plain(said, ["doc_id", "seq", "success", "message"])
    assert plain(made, ["doc_id", "p_idx", "change_id", "change_type", "text"]) == plain(change_rows, ["doc_id", "p_idx", "change_id", "change_type", "text"])
    assert plain(after, columns) == plain(now.collect(), columns)
    assert n <= 5


def test_regular_expressions(spark):
    docs = {d: [["ab cost 5 and ab"], ["aab b"]] for d in "abcdefg"}
    todo = [
        edit("a", 1, "replace_tracked", find=r"cost (\d)", replace=r"price $5.00 \1 \g<1>", regex=True),
        edit("b", 1, "replace", find="(?<=a)b", replace="X", regex=True, occurrence="all"),
        edit("c", 1, "replace", find="(", replace="X", regex=True),
        edit("c", 2, "delete", find="cost "),
        edit("d", 1, "replace", find="a(b)", replace=r"\2", regex=True),
        edit("e", 1, "replace", find=r"(?P<n>\w)b\b", replace=r"\g<n>\\$", regex=True, occurrence="[1, 3]"),
        edit("f", 1, "replace", find="b*", replace="-", regex=True, occurrence="all"),
        edit("g", 1, "delete", text="ab$", regex=True, occurrence="all"),
    ]
    after, _, results = tracked.apply(plain_runs(spark, docs), spark.createDataFrame(todo, EDITS))
    said = {(r.doc_id, r.seq): (r.success, r.message) for r in results.collect()}
    assert {k for k, (ok, _) in said.items() if not ok} == {("c", 1), ("d", 1)}
    assert all("regular expression can't be read" in said[k][1] for k in (("c", 1), ("d", 1)))
    got = {d: [texts(after.where(F.col("doc_id") == d))[tracked.BODY, p] for p in (0, 1)] for d in docs}
    assert got["a"] == ["ab price $5.00 5 5 and ab", "aab b"]
    assert got["b"] == ["aX cost 5 and aX", "aaX b"]
    assert got["c"] == ["ab 5 and ab", "aab b"] and got["d"] == ["ab cost 5 and ab", "aab b"]
    assert got["e"] == ["a\\$ cost 5 and ab", "aa\\$ b"]
    assert got["f"] == ["a- cost 5 and a-", "aa- -"]
    assert got["g"] == ["ab cost 5 and ", "aab b"]


def test_occurrence_lists(spark):
    docs = {d: [["x a x"], ["x x"]] for d in "abcd"}
    todo = [edit(d, 1, "replace", find="x", replace="y", occurrence=o) for d, o in zip("abcd", ("[1, 3]", "2,4", "[1, 9]", "word"), strict=True)]
    after, _, results = tracked.apply(plain_runs(spark, docs), spark.createDataFrame(todo, EDITS))
    got = {d: [texts(after.where(F.col("doc_id") == d))[tracked.BODY, p] for p in (0, 1)] for d in docs}
    assert got == {"a": ["y a x", "y x"], "b": ["x a y", "x y"], "c": ["x a x", "x x"], "d": ["x a x", "x x"]}
    assert {r.doc_id: r.message for r in results.collect()} == {"a": "replaced 2", "b": "replaced 2", "c": "occurrence [1, 9] of 4", "d": "occurrence word of 4"}


def test_overlapping_hits(spark):
    p = spark.createDataFrame([(1, 0, "banana aaaa"), (1, 1, "ananana"), (1, 2, "AnAna"), (1, 3, "x")], "doc_id long, p_idx int, text string")
    rows = {(r.p_idx, r.text) for r in p.collect()}
    for find in ("ana", "aa", "a", "anana"):
        for fold in (False, True):
            want = []
            for i, t in sorted(rows):
                low = t.lower() if fold else t
                want += [(i, at, len(find), t[at : at + len(find)]) for at in range(len(t)) if low.startswith(find, at)]
            got = [(r.p_idx, r.pos, r.len, r.found) for r in search.find_all(p, find, case_sensitive=not fold).orderBy("p_idx", "pos").collect()]
            assert got == want


def rejected(after):
    """What was there before: without insertions, with deletions back."""
    return tracked.visible(after.where("not coalesce(in_ins, false)").withColumn("text", F.concat("text", F.coalesce("del_text", F.lit("")))))


def test_minimal_edits(spark, monkeypatch):
    """Only words that differ are marked, over run edges; paragraphs with changes, or unfit ones, are replaced whole."""
    docs = {"a": [["pay within 3", "0 days of the notice", " then"], ["pay within 30 days of the notice"]], "b": [["pay within 30 days of the notice"]], "c": [["pay within 30 days of the notice"]], "d": [["x  y"]]}
    rows = [edit(d, 1, "replace_tracked", find="within 30 days of the notice", replace="within 45 days of a written notice") for d in "abc"] + [edit("d", 1, "replace_tracked", find="x  y", replace="x y")]
    rows += [edit("a", 2, "replace_tracked", find="of a written", replace="of any written")]
    todo = spark.createDataFrame(rows, EDITS).withColumn("minimal", F.lit(True))
    unfit = spark.createDataFrame([("c", tracked.BODY, 0)], "doc_id string, part string, p_idx int")
    rounds = counted_rounds(monkeypatch)
    after, made, results = tracked.apply(plain_runs(spark, docs), todo, unfit=unfit)
    assert all(r.success for r in results.collect()) and len(rounds) == 2
    got = {}
    for r in sorted(made.collect(), key=lambda r: int(r.change_id)):
        got.setdefault(r.doc_id, []).append((r.change_type, r.text))
    fine = [("deletion", "30"), ("insertion", "45"), ("deletion", "the"), ("insertion", "a written")]
    whole = [("deletion", "within 30 days of the notice"), ("insertion", "within 45 days of a written notice")]
    # The second edit of a meets a paragraph with changes.
    assert got == {"a": [*fine, ("deletion", "of a written"), ("insertion", "of any written")], "b": fine, "c": whole}
    seen = {(r.doc_id, r.p_idx): r.text for r in tracked.visible(after).collect()}
    assert seen[("a", 0)] == "pay within 45 days of any written notice then" and seen[("b", 0)] == seen[("c", 0)] == "pay within 45 days of a written notice" and seen[("d", 0)] == "x  y"


@pytest.mark.parametrize("seed", range(2))
def test_hunks_projected_onto_runs(spark, seed):
    """Random versions of paragraphs, cut into runs anywhere: accepting gives the new one, rejecting the old, and what both have isn't marked."""
    rng = random.Random(seed)
    words = ["red", "owl", "sat", "on", "a", "mat", ",", "."]
    docs, rows = {}, []
    for d in range(30):
        old = [rng.choice(words) for _ in range(rng.randrange(8))]
        new = [w for w in old if rng.random() < 0.8] + ([rng.choice(words)] if rng.random() < 0.5 else [])
        if rng.random() < 0.5:
            new.insert(rng.randrange(len(new) + 1), "new")
        text, cut = " ".join(old), rng.randrange(1, 6)
        docs[str(d)] = [[text[i : i + cut] for i in range(0, len(text), cut)] or [""]]
        rows.append((str(d), tracked.BODY, 0, " ".join(new)))
    runs = plain_runs(spark, docs)
    after, made = tracked.replaced_minimal(runs, spark.createDataFrame(rows, "doc_id string, part string, p_idx int, new string"))
    now, was = ({r.doc_id: r.text for r in f.collect()} for f in (tracked.visible(after), rejected(after)))
    marked = {}
    for r in made.collect():
        marked.setdefault(r.doc_id, []).append((r.change_type, r.text))
    for d, _, _, new in rows:
        old = "".join(docs[d][0])
        want = diff.text_hunks(old, new)
        kept = old
        for h in reversed(want or []):
            kept = kept[: h["start"]] + h["new"] + kept[h["end"] :]
        assert was.get(d, "") == old and now.get(d, "") == kept and kept.split() == new.split()
        assert sorted(marked.get(d, [])) == sorted([("deletion", h["old"]) for h in want if h["old"]] + [("insertion", h["new"]) for h in want if h["new"]])


def test_regular_expressions_with_empty_matches(spark):
    import re

    p = spark.createDataFrame([(1, 0, "baac aab"), (1, 1, ""), (1, 2, "xyz"), (1, 3, "aa$1 \\a")], "doc_id long, p_idx int, text string")
    rows = sorted((r.p_idx, r.text) for r in p.collect())
    for find in ("a*", "(?<=a)a|b", "a+(?=c)", "(a)(b)?", r"\$|\\", "x*"):
        want = [(i, m.start(), m.group()) for i, t in rows for m in re.finditer(find, t) if m.group()]
        got = [(r.p_idx, r.pos, r.found) for r in search.find_all(p, find, regex=True).orderBy("p_idx", "pos").collect()]
        assert got == want


def test_results_are_those_of_their_sql(spark, tmp_path):
    """Texts that hold the capitals that an edit puts in, and a document without text."""
    import duckdb

    from inkloom.plans.edit_queries import QUERIES, SQL

    rows = [(1, "IDIOT"), (2, "an idiot IDIOT"), (3, None), (4, "idiot idiot\nIDIOT"), (5, ""), (6, "the rest")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["edit_results"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(db.execute(SQL["edit_results"]).fetchall()) and len(got) == 20


def test_many_edits_are_not_broadcast(spark, monkeypatch):
    """Edits of many documents are merged with what they are joined with, however small their files are; the rows are the same."""
    sent, plain = [], tracked.written

    def seen(df, name):
        if name in ("matches", "wanted", "cuts"):
            sent.append("BroadcastHashJoin" in df._jdf.queryExecution().sparkPlan().toString())
        return plain(df, name)

    runs = spark.range(30).selectExpr("id as doc_id", "'word/document.xml' as part", "0 as p_idx", "0 as r_idx", "'one two one' as text", "'' as del_text", "false as in_ins", "false as in_del", "string(null) as change_id")
    todo = spark.range(30).selectExpr("id as doc_id", "explode(array(named_struct('seq', 1, 'find', 'one', 'replace', '<1>'), named_struct('seq', 2, 'find', '<1>', 'replace', '<one>'))) as e").selectExpr("doc_id", "e.*", "'replace' as type", "'all' as occurrence")
    few = sorted(map(tuple, tracked.visible(tracked.apply(runs, todo)[0]).collect()))
    monkeypatch.setattr(tracked, "MANY", 10)
    monkeypatch.setattr(tracked, "written", seen)
    assert sorted(map(tuple, tracked.visible(tracked.apply(runs, todo)[0]).collect())) == few and few[0][3] == "<one> two <one>"
    assert len(sent) == 6 and not any(sent)
