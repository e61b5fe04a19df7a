"""What edits add to packages: new parts, relationships, content types, elements of parts and of paragraphs.

All of it is rows of one table of patches, keyed by document, which joins, windows and expressions
build for all documents at once; ids go on from the greatest that a document has. `patched` brings a
package and its patches together in one row and writes it, every other part as it was.

Kinds of patches: part (content), rel (of a source part), type (of an extension or a part), element (appended to
the root of a part, which is made if it isn't there), inline (put into a paragraph at a place of its text), start and
end (at the two ends of a paragraph), properties (of a paragraph, over those that it has).
"""

from __future__ import annotations

import copy
import io
import zipfile
from collections.abc import Iterator
from functools import lru_cache, reduce
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators import tracked
from inkloom.sources import docx

PATCH = {"kind": "string", "part": "string", "p_idx": "int", "at": "int", "seq": "int", "rel_id": "string", "rel_type": "string", "target": "string", "mode": "string", "content_type": "string", "xml": "string", "content": "binary"}
# Kinds of relationships, content types, namespaces of pictures.
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
COMMENTS = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"
SPACES = {
    "w": docx.W[1:-1], "r": REL, "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "pic": "http://schemas.openxmlformats.org/drawingml/2006/picture",
}
# The order of a paragraph's properties.
PROPERTIES = (
    "pStyle", "keepNext", "keepLines", "pageBreakBefore", "framePr", "widowControl", "numPr", "suppressLineNumbers", "pBdr", "shd", "tabs", "suppressAutoHyphens", "kinsoku", "wordWrap", "overflowPunct", "topLinePunct", "autoSpaceDE",
    "autoSpaceDN", "bidi", "adjustRightInd", "snapToGrid", "spacing", "ind", "contextualSpacing", "mirrorIndents", "suppressOverlap", "jc", "textDirection", "textAlignment", "textboxTightWrap", "outlineLvl", "divId", "cnfStyle", "rPr",
    "sectPr", "pPrChange",
)
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_CONTENT = "{http://schemas.openxmlformats.org/package/2006/content-types}"


def patches(rows: DataFrame, kind: str, **given: Column | str) -> DataFrame:
    """Patches of one kind from rows that have doc_id."""
    value = lambda c: F.lit(kind) if c == "kind" else (given[c] if isinstance(given[c], Column) else F.col(given[c])) if c in given else F.lit(None)
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), *(value(c).cast(k).alias(c) for c, k in PATCH.items()))


def attribute(text: Column) -> Column:
    return F.replace(docx.escaped(text), F.lit('"'), F.lit("&quot;"))


def joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _number(c: str, pattern: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({c}, '{pattern}', 1) as int)")


def _anchored(paragraphs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits with part, p_idx and at, behind the one place that their text `after` has in their scope; results)."""
    null = lambda kind: F.lit(None).cast(kind)
    scope = F.col("scope") if "scope" in edits.columns else null("string")
    asked = edits.select("doc_id", "seq", F.coalesce("after", F.lit("")).alias("find"), F.lit(False).alias("regex"), scope.alias("scope"), null("string").alias("ref"), null("string").alias("new"))
    hits = tracked.matches(paragraphs, asked.where("find <> ''"), regex=False)
    one = edits.join(hits.groupBy("doc_id", "seq").agg(F.max("of").alias("of"), F.first("part").alias("part"), F.first("p_idx").alias("p_idx"), F.first("end").alias("at")), ["doc_id", "seq"], "left")
    wrong = F.when(F.col("of").isNull(), joined("text not found: ", F.coalesce("after", F.lit("")))).when(F.col("of") > 1, joined("text is ambiguous: ", F.col("of").cast("string"), " occurrences of ", F.col("after")))
    one = one.withColumn("wrong", wrong)
    return one.where("wrong is null").drop("wrong", "of"), one.select("doc_id", "seq", F.col("wrong").isNull().alias("success"), F.coalesce("wrong", F.lit("inserted 1")).alias("message"))


def _rel_ids(rows: DataFrame, relationships: DataFrame, wanted: Column) -> DataFrame:
    """rows with rel_id where wanted: on from the greatest of their document, in the order of seq."""
    top = relationships.groupBy("doc_id").agg(F.max(_number("rel_id", "(\\\\d+)$")).alias("top"))
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.coalesce("top", F.lit(0)) + F.sum(wanted.cast("int")).over(order)
    return rows.join(top, "doc_id", "left").withColumn("rel_id", F.when(wanted, F.concat(F.lit("rId"), number.cast("string")))).drop("top")


def links(paragraphs: DataFrame, relationships: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches, results) of edits (doc_id, seq, text, after, url, anchor, scope): a link behind a text of the body, or of headers, footers, footnotes or endnotes.

    Either url, which gets a relationship of the part that the link is in, or anchor, a bookmark's name.
    """
    fit = edits.where(F.col("url").isNull() != F.col("anchor").isNull())
    wrong = edits.where(F.col("url").isNull() == F.col("anchor").isNull()).select("doc_id", "seq", F.lit(False).alias("success"), F.lit("give either url or anchor").alias("message"))
    at, said = _anchored(paragraphs, fit)
    at = _rel_ids(at, relationships, F.col("url").isNotNull())
    where = F.when(F.col("url").isNotNull(), joined('r:id="', F.col("rel_id"), '"')).otherwise(joined('w:anchor="', attribute(F.col("anchor")), '"'))
    xml = joined("<w:hyperlink ", where, '><w:r><w:rPr><w:rStyle w:val="Hyperlink"/></w:rPr><w:t xml:space="preserve">', docx.escaped(F.col("text")), "</w:t></w:r></w:hyperlink>")
    made = patches(at, "inline", part="part", p_idx="p_idx", at="at", seq="seq", xml=xml)
    rels = patches(at.where("url is not null"), "rel", part="part", rel_id="rel_id", rel_type=F.lit(f"{REL}/hyperlink"), target="url", mode=F.lit("External"), seq="seq")
    return made.unionByName(rels), said.unionByName(wrong)


def images(paragraphs: DataFrame, relationships: DataFrame, parts: DataFrame, edits: DataFrame, tops: DataFrame | None = None, author: str = "Inkloom", date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """(patches, results) of edits (doc_id, seq, name, extension, content, width_inches, height_inches, after, scope, track): a picture behind a text.

    A tracked one is an insertion, its id on from tops (tracked.top_ids). Media are numbered on from those that the package has (parts).
    """
    known = F.lower("extension").isin(*TYPES)
    wrong = edits.where(~known).select("doc_id", "seq", F.lit(False).alias("success"), joined("unknown kind of picture: ", F.col("extension")).alias("message"))
    at, said = _anchored(paragraphs, edits.where(known))
    at = _rel_ids(at, relationships, F.lit(True)).withColumn("extension", F.lower("extension"))
    media = parts.groupBy("doc_id").agg(F.max(_number("part", "media/image(\\\\d+)")).alias("m"))
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = (F.coalesce("m", F.lit(0)) + F.row_number().over(order)).cast("string")
    at = at.join(media, "doc_id", "left").withColumn("number", number).withColumn("media", joined("media/image", F.col("number"), ".", F.col("extension")))
    track = F.coalesce("track", F.lit(False)) if "track" in at.columns else F.lit(False)
    top = at.select("doc_id").distinct().withColumn("top", F.lit(0)) if tops is None else tops
    at = at.join(top, "doc_id", "left").withColumn("change", F.coalesce("top", F.lit(0)) + F.sum(track.cast("int")).over(order))
    emu = lambda c: F.round(F.col(c) * 914400).cast("long").cast("string")
    size = lambda tag: joined(f"<{tag} cx=\"", emu("width_inches"), '" cy="', emu("height_inches"), '"/>')
    named = lambda tag: joined(f"<{tag} id=\"", F.col("number"), '" name="', attribute(F.col("name")), '"/>')
    run = joined(
        '<w:r><w:drawing><wp:inline distT="0" distB="0" distL="0" distR="0">', size("wp:extent"), named("wp:docPr"), f'<a:graphic><a:graphicData uri="{SPACES["pic"]}"><pic:pic><pic:nvPicPr>', named("pic:cNvPr"), "<pic:cNvPicPr/></pic:nvPicPr>",
        '<pic:blipFill><a:blip r:embed="', F.col("rel_id"), '"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/>', size("a:ext"), '</a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr>',
        "</pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>",
    )
    outer = joined('<w:ins w:id="', F.col("change").cast("string"), '" w:author="', attribute(F.lit(author)), f'" w:date="{date}">', run, "</w:ins>")
    kinds = F.element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), F.col("extension"))
    return (
        reduce(DataFrame.unionByName, [
            patches(at, "inline", part="part", p_idx="p_idx", at="at", seq="seq", xml=F.when(track, outer).otherwise(run)),
            patches(at, "rel", part="part", rel_id="rel_id", rel_type=F.lit(f"{REL}/image"), target="media", seq="seq"),
            patches(at, "part", part=joined("word/", F.col("media")), content="content", seq="seq"), patches(at, "type", target="extension", content_type=kinds, seq="seq"),
        ]),
        said.unionByName(wrong),
    )


#: What a reference shows until it is updated, where that can't be known here.
_UNKNOWN = "?"


def references(paragraphs: DataFrame, bookmarks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches, results) of edits (doc_id, seq, target, after, scope, kind, display, linked): a cross-reference field behind a text.

    kind is REF (by default), PAGEREF or NOTEREF, target a bookmark of the document, display one of entity_edits.DISPLAY. A field is five runs that
    stand together (begin, code, separate, result, end) and is marked as out of date; its result is the bookmark's text where it shows a text.
    """
    from inkloom.operators.entity_edits import DISPLAY

    for c, kind in {"kind": "string", "display": "string", "linked": "boolean", "scope": "string"}.items():
        edits = edits.withColumn(c, (F.col(c) if c in edits.columns else F.lit(None)).cast(kind))
    e = edits.withColumn("kind", F.coalesce("kind", F.lit("REF"))).withColumn("display", F.coalesce("display", F.when(F.col("kind") == "PAGEREF", "page").otherwise("text")))
    known = bookmarks.groupBy("doc_id", F.col("name").alias("target")).agg(F.min_by("preview", "p_idx").alias("preview")).withColumn("there", F.lit(True))
    e = e.join(known, ["doc_id", "target"], "left")
    wrong = (
        F.when(~F.col("kind").isin("REF", "PAGEREF", "NOTEREF"), joined("unknown kind of reference: ", F.col("kind"))).when(~F.col("display").isin(*DISPLAY), joined("display must be one of ", ", ".join(sorted(DISPLAY)), ", not ", F.col("display")))
        .when(F.col("there").isNull(), joined("no bookmark ", F.coalesce("target", F.lit(""))))
    )
    e = e.withColumn("bad", wrong)
    at, said = _anchored(paragraphs, e.where("bad is null"))
    refused = e.where("bad is not null").select("doc_id", "seq", F.lit(False).alias("success"), F.col("bad").alias("message"))
    switch = F.element_at(F.create_map(*(F.lit(x) for kv in DISPLAY.items() for x in kv)), F.col("display"))
    name = F.when(F.col("display") == "page", "PAGEREF").otherwise(F.col("kind"))
    code = F.array_join(F.filter(F.array(name, F.col("target"), switch, F.when(F.coalesce("linked", F.lit(True)), "\\h").otherwise("")), lambda x: x != ""), " ")
    shown = F.when((F.col("display") == "text") & (name == "REF"), F.coalesce("preview", F.lit(""))).otherwise(_UNKNOWN)
    char = lambda what, more="": f'<w:r><w:fldChar w:fldCharType="{what}"{more}/></w:r>'
    xml = joined(char("begin", ' w:dirty="true"'), '<w:r><w:instrText xml:space="preserve"> ', docx.escaped(code), " </w:instrText></w:r>", char("separate"), '<w:r><w:t xml:space="preserve">', docx.escaped(shown), "</w:t></w:r>", char("end"))
    return patches(at, "inline", part="part", p_idx="p_idx", at="at", seq="seq", xml=xml), said.unionByName(refused)


def comments(before: DataFrame, after: DataFrame, ranges: DataFrame, relationships: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Patches that save the comments of after (doc_id, comment_id, author, initials, text) that before hasn't, on the paragraphs of ranges (doc_id, comment_id, start_p_idx, end_p_idx)."""
    new = after.join(before.select("doc_id", "comment_id"), ["doc_id", "comment_id"], "left_anti").join(ranges.select("doc_id", "comment_id", "start_p_idx", "end_p_idx"), ["doc_id", "comment_id"])
    new = tracked.written(new, "new-comments")
    number = F.col("comment_id").cast("int")
    id_ = joined('w:id="', attribute(F.col("comment_id")), '"')
    body = joined("<w:comment ", id_, ' w:author="', attribute(F.coalesce("author", F.lit(""))), '" w:initials="', attribute(F.coalesce("initials", F.lit(""))), f'" w:date="{date}"><w:p><w:r><w:t xml:space="preserve">', docx.escaped(F.coalesce("text", F.lit(""))), "</w:t></w:r></w:p></w:comment>")
    mark = joined("<w:r><w:commentReference ", id_, "/></w:r>")
    lone = new.select("doc_id").distinct().join(relationships.where("rel_type = 'comments'").select("doc_id"), "doc_id", "left_anti").withColumn("seq", F.lit(0))
    rel = _rel_ids(lone, relationships, F.lit(True))
    part = F.lit("word/comments.xml")
    return reduce(DataFrame.unionByName, [
        patches(new, "element", part=part, seq=number, xml=body, target=F.lit("w:comments")),
        patches(new, "start", part=F.lit(tracked.BODY), p_idx="start_p_idx", seq=number, xml=joined("<w:commentRangeStart ", id_, "/>")),
        patches(new, "end", part=F.lit(tracked.BODY), p_idx="end_p_idx", seq=number, xml=joined("<w:commentRangeEnd ", id_, "/>", mark)),
        # A package that has comments keeps its relationship; one without gets it under an id above all there are.
        patches(rel, "rel", part=F.lit(tracked.BODY), rel_id=F.concat("rel_id", F.lit("c")), rel_type=F.lit(f"{REL}/comments"), target=F.lit("comments.xml"), seq=F.lit(0)),
        patches(new.select("doc_id").distinct(), "type", part=part, content_type=F.lit(COMMENTS), seq=F.lit(0)),
    ])


def patched(found: DataFrame, *tables: DataFrame) -> DataFrame:
    """(doc_id, content): packages (doc_id, content) with their patches; those without, and those that can't be read, as they were."""
    order = ["kind", "seq", *(c for c in PATCH if c not in ("kind", "seq"))]
    rows = reduce(DataFrame.unionByName, tables)
    packed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("patches"))
    both = found.select(F.col("doc_id").cast("string").alias("doc_id"), "content").join(packed, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_patched(c, p) if c and p and zipfile.is_zipfile(io.BytesIO(c)) else c for c, p in zip(batch.column("content").to_pylist(), batch.column("patches").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return both.mapInArrow(run, "doc_id string, content binary")


def _patched(content: bytes, rows: list[dict]) -> bytes:
    with zipfile.ZipFile(io.BytesIO(content)) as old:
        parts = {info.filename: old.read(info.filename) for info in old.infolist()}
    changed: dict[str, list[dict]] = {}
    for row in rows:
        if row["kind"] == "part":
            parts[row["part"]] = bytes(row["content"] or b"")
        else:
            name = row["part"]
            if row["kind"] == "rel":
                folder, _, file = name.rpartition("/")
                name = f"{folder}/_rels/{file}.rels"
            elif row["kind"] == "type":
                name = "[Content_Types].xml"
            changed.setdefault(name, []).append(row)
    for name, mine in changed.items():
        body = parts.get(name)
        # Most packages have the same relationships and content types, and often get the same.
        small = len(body or b"") + sum(len(x["xml"] or "") for x in mine) < 4096 and not any(x["content"] for x in mine)
        parts[name] = _small_part(body, name, tuple(tuple(x.items()) for x in mine)) if small else _part(body, name, mine)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as new:
        for name, body in parts.items():
            new.writestr(zipfile.ZipInfo(name), body)
    return data.getvalue()


@lru_cache(1024)
def _small_part(body: bytes | None, name: str, rows: tuple) -> bytes:
    return _part(body, name, [dict(x) for x in rows])


def _element(xml: str) -> list[ET.Element]:
    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in SPACES.items())
    return list(ET.fromstring(f"<x {spaces}>{xml}</x>"))


def _part(body: bytes | None, name: str, rows: list[dict]) -> bytes:
    for prefix, uri in SPACES.items():
        ET.register_namespace(prefix, uri)
    for prefix, uri in docx.namespaces(body) if body else ():
        if not (prefix.startswith("ns") and prefix[2:].isdigit()) and (prefix or uri):
            ET.register_namespace(prefix, uri)
    if name.endswith(".rels"):
        root = ET.fromstring(body) if body else ET.Element(_PACKAGE + "Relationships")
        for row in rows:
            ET.SubElement(root, _PACKAGE + "Relationship", {"Id": row["rel_id"], "Type": row["rel_type"], "Target": row["target"], **({"TargetMode": row["mode"]} if row["mode"] else {})})
    elif name == "[Content_Types].xml":
        root = ET.fromstring(body) if body else ET.Element(_CONTENT + "Types")
        there = {(e.get("Extension") or e.get("PartName")) for e in root}
        for row in rows:
            key = row["target"] or "/" + row["part"]
            if key not in there:
                there.add(key)
                root.append(ET.Element(_CONTENT + ("Default" if row["target"] else "Override"), {"Extension" if row["target"] else "PartName": key, "ContentType": row["content_type"]}))
    else:
        root = ET.fromstring(body) if body else _element(f"<{rows[0]['target']}/>")[0]
        paragraphs = list(docx._walk_paragraphs(root))
        for row in rows:
            if row["kind"] == "element":
                root.extend(_element(row["xml"]))
        # Places are those of the text as it was: the last first.
        for row in sorted((r for r in rows if r["kind"] == "inline"), key=lambda r: (r["at"], r["seq"]), reverse=True):
            _put(paragraphs[row["p_idx"]], row["at"], _element(row["xml"]))
        for row in rows:
            if row["kind"] == "properties":
                _format(paragraphs[row["p_idx"]], _element(row["xml"])[0])
        for row in rows:
            if row["kind"] in ("start", "end"):
                p = paragraphs[row["p_idx"]]
                first = 1 if len(p) and p[0].tag == docx.W + "pPr" else 0
                p[:] = [*p[:first], *_element(row["xml"]), *p[first:]] if row["kind"] == "start" else [*p, *_element(row["xml"])]
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def _put(p: ET.Element, at: int, new: list[ET.Element]) -> None:
    """Puts elements behind the first `at` characters of a paragraph's text; within a change or a link, behind it."""
    top = {child: e for e in p for child in e.iter()}
    done = 0
    for run, parent in docx._walk_runs(p):
        text = docx._texts(run, "t")
        done += len(text)
        if done < at or not text:
            continue
        own = run.findall(docx.W + "t")
        place = list(p).index(top[run]) + 1
        if done > at and parent is p and len(own) == 1:
            rest = copy.deepcopy(run)
            cut = len(text) - (done - at)
            own[0].text, rest.find(docx.W + "t").text = text[:cut], text[cut:]
            for piece in (own[0], rest.find(docx.W + "t")):
                piece.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            for e in [e for e in rest if e.tag not in (docx.W + "t", docx.W + "rPr")]:
                rest.remove(e)
            new = [*new, rest]
        p[place:place] = new
        return
    p.extend(new)


def _format(p: ET.Element, new: ET.Element) -> None:
    """Sets properties of a paragraph; a change among the new ones takes in what there was, but for the mark's own and the section's."""
    place = lambda e: PROPERTIES.index(e.tag.removeprefix(docx.W)) if e.tag.removeprefix(docx.W) in PROPERTIES else len(PROPERTIES) - 2
    own = p.find(docx.W + "pPr")
    if own is None:
        own = ET.Element(docx.W + "pPr")
        p.insert(0, own)
    change = new.find(docx.W + "pPrChange")
    if change is not None:
        was = ET.SubElement(change, docx.W + "pPr")
        was.extend(copy.deepcopy(e) for e in own if e.tag not in {docx.W + t for t in ("rPr", "sectPr", "pPrChange")})
    for e in new:
        there = own.find(e.tag)
        if there is not None and e.tag in (docx.W + "spacing", docx.W + "ind"):
            there.attrib.update(e.attrib)
            continue
        if there is not None:
            own.remove(there)
        own.append(e)
    own[:] = sorted(own, key=place)
