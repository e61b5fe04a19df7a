"""Word-processor packages: read into entity tables, and written back from them.

A package is one row of `content`; parsing happens inside tasks, one package at a time. All entities
of a package come out of one pass as rows of one table, tagged by kind, so that packages are
unzipped once; `entity()` projects one kind.
"""

from __future__ import annotations

import copy
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
W15 = "{http://schemas.microsoft.com/office/word/2012/wordml}"
# Tracked-change elements and what they are called.
CHANGES = {"ins": "insertion", "del": "deletion", "moveFrom": "move_from", "moveTo": "move_to", "rPrChange": "format_run", "pPrChange": "format_paragraph"}

FIELDS = {
    "parts": "part string, size long",
    "paragraphs": "part string, p_idx int, body_p_idx int, style string, outline_lvl int, location string, tbl_idx int, row_idx int, cell_idx int, text string, text_model string, text_search string, mark_deleted boolean, n_runs int, n_child_runs int, all_bold boolean, note_id string, has_revisions boolean, has_unsupported boolean",
    "paragraph_properties": "part string, p_idx int, alignment string, spacing_before double, spacing_after double, line_spacing double, indent_left double, indent_right double, indent_first_line double, indent_hanging double, tab_stops array<struct<position: double, kind: string, leader: string>>",
    "runs": "part string, p_idx int, r_idx int, text string, del_text string, in_ins boolean, in_del boolean, change_id string, author string, date string, note_id string, bold boolean, italic boolean, color string, old_bold boolean, old_italic boolean, old_color string",
    "changes": "part string, elem_idx int, change_id string, change_type string, author string, date string, text string, p_idx int",
    "comments": "comment_id string, author string, initials string, date string, text string, para_id string",
    "comment_ranges": "part string, comment_id string, start_p_idx int, end_p_idx int, marked_text string",
    "comment_ex": "para_id string, parent_para_id string, done boolean",
    "notes": "note_kind string, note_id string, w_type string, text string",
    "note_refs": "part string, note_kind string, note_id string, p_idx int",
    "bookmarks": "part string, name string, bookmark_id string, p_idx int, preview string",
    "hyperlinks": "part string, link_idx int, p_idx int, text string, anchor string, rel_id string",
    "fields": "part string, field_idx int, p_idx int, code string, display string, dirty boolean",
    "relationships": "source_part string, rel_id string, rel_type string, target string, mode string",
    "content_types": "part string, extension string, content_type string",
    "styles": "style_id string, style_type string, name string, based_on string, hidden boolean",
    "headers_footers": "part string, role string, text string",
    "images": "part string, p_idx int, rel_id string, width long, height long, name string",
    "errors": "part string, error string",
}
ROWS = "doc_id string, kind string, row string"
# Elements that hold paragraphs, elements within a paragraph that hold runs, and those that hunks can't be applied through.
NESTING = {W + t for t in ("sdt", "sdtContent", "ins", "customXml", "footnote", "endnote")}
WRAPPING = ("sdt", "sdtContent", "smartTag", "customXml")
MARKS = {W + t for t in ("ins", "del", "moveFrom", "moveTo")}
UNSUPPORTED = {W + t for t in ("hyperlink", "fldSimple", "fldChar", "sdt", "smartTag")}
_CHANGED = {W + t for t in CHANGES} | set(CHANGES)
_T, _DEL_TEXT = W + "t", W + "delText"
# Parts that give entities of one kind.
_LONE = {"[Content_Types].xml": "content_types", "word/comments.xml": "comments", "word/commentsExtended.xml": "comment_ex", "word/styles.xml": "styles"}


def packages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of the packages under path; doc_id is the file's path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.col("path").alias("doc_id"), "content")


def _on(e: ET.Element | None) -> bool | None:
    return None if e is None else e.get(W + "val") not in ("0", "false", "none")


def _flag(value: str | None) -> bool:
    return value in ("1", "true", "on")


def _texts(e: ET.Element, *tags: str) -> str:
    names = {W + t for t in tags}
    return "".join(x.text or "" for x in e.iter() if x.tag in names)


def _props(rpr: ET.Element | None, prefix: str = "") -> dict:
    if rpr is None:
        return {}
    color = rpr.find(W + "color")
    return {prefix + "bold": _on(rpr.find(W + "b")), prefix + "italic": _on(rpr.find(W + "i")), prefix + "color": None if color is None else color.get(W + "val")}


def _paragraph_properties(ppr: ET.Element) -> dict:
    """Properties of a paragraph that are set: lengths in points and inches."""

    def number(tag: str, name: str, per: float) -> float | None:
        e = ppr.find(W + tag)
        value = "" if e is None else e.get(W + name) or ""
        return int(value) / per if value.lstrip("-").isdigit() else None

    jc, tabs = ppr.find(W + "jc"), ppr.findall(f"{W}tabs/{W}tab")
    align = None if jc is None else jc.get(W + "val")
    out = {
        "alignment": "justify" if align == "both" else align, "spacing_before": number("spacing", "before", 20), "spacing_after": number("spacing", "after", 20), "line_spacing": number("spacing", "line", 240),
        "indent_left": number("ind", "left", 1440), "indent_right": number("ind", "right", 1440), "indent_first_line": number("ind", "firstLine", 1440), "indent_hanging": number("ind", "hanging", 1440),
        "tab_stops": [{"position": int(t.get(W + "pos") or 0) / 1440, "kind": t.get(W + "val"), "leader": t.get(W + "leader")} for t in tabs] or None,
    }
    return {k: v for k, v in out.items() if v is not None}


class _Part:
    """Rows of one text part; of paragraphs, the widest rows, none are made where kinds are given without them."""

    def __init__(self, name: str, root: ET.Element, emit, kinds: frozenset[str] | None = None):
        self.name, self.emit = name, emit
        self.rows_of_paragraphs = kinds is None or "paragraphs" in kinds
        self.p_idx = self.elem_idx = self.field_idx = self.link_idx = 0
        self.body_idx = 0
        self.open_comments: dict[str, list] = {}
        self.field: list | None = None
        self.tables = -1
        self.note_id: str | None = None
        body = root.find(W + "body")
        self.block(body if body is not None else root, ())
        for cid, (start, texts) in self.open_comments.items():
            emit("comment_ranges", {"part": name, "comment_id": cid, "start_p_idx": start, "end_p_idx": None, "marked_text": "".join(texts)})

    def block(self, parent: ET.Element, cell: tuple) -> None:
        for e in parent:
            if e.tag == W + "p":
                self.paragraph(e, cell, None if cell else self.body_idx)
                self.body_idx += not cell
            elif e.tag == W + "tbl":
                self.tables += 1
                table = self.tables
                for r, row in enumerate(e.findall(W + "tr")):
                    for mark in row.findall(f"{W}trPr/*"):
                        self.change(mark, "", None)
                    for c, td in enumerate(row.findall(W + "tc")):
                        self.block(td, (table, r, c))
            elif e.tag in NESTING:
                if e.tag in (W + "footnote", W + "endnote"):
                    self.note_id = e.get(W + "id")
                self.block(e, cell)

    def change(self, e: ET.Element, text: str, p_idx: int | None) -> None:
        kind = CHANGES.get(e.tag.removeprefix(W))
        if kind:
            self.emit("changes", {"part": self.name, "elem_idx": self.elem_idx, "change_id": e.get(W + "id"), "change_type": kind, "author": e.get(W + "author"), "date": e.get(W + "date"), "text": text, "p_idx": p_idx})
            self.elem_idx += 1

    def paragraph(self, p: ET.Element, cell: tuple, body_idx: int | None) -> None:
        ppr = p.find(W + "pPr")
        style, level = (None, None) if ppr is None else (ppr.find(W + "pStyle"), ppr.find(W + "outlineLvl"))
        self.r_idx, self.searched, self.bold = 0, [], []
        if ppr is not None:
            for e in ppr.iter():
                self.change(e, "", self.p_idx)
            set_ = _paragraph_properties(ppr)
            if set_:
                self.emit("paragraph_properties", {"part": self.name, "p_idx": self.p_idx, **set_})
        self.inline(p, {})
        if self.rows_of_paragraphs:
            self.put_paragraph(p, cell, body_idx, ppr, style, level)
        self.p_idx += 1

    def put_paragraph(self, p: ET.Element, cell: tuple, body_idx: int | None, ppr: ET.Element | None, style: ET.Element | None, level: ET.Element | None) -> None:
        mark = ppr is not None and p.find(f"{W}pPr/{W}rPr/{W}del") is not None
        texts, gone, revised, unsupported = [], [], False, False
        for x in p.iter():
            tag = x.tag
            if tag == _T:
                texts.append(x.text or "")
            elif tag == _DEL_TEXT:
                gone.append(x.text or "")
            elif tag in _CHANGED:
                revised = True
            elif tag in UNSUPPORTED:
                unsupported = True
        text = "".join(texts)
        place = "body" if not cell else f"table:{cell[0]}:row:{cell[1]}:cell:{cell[2]}"
        kind = self.name.rpartition("/")[2].rstrip("0123456789.xml")
        self.emit("paragraphs", {
            "part": self.name, "p_idx": self.p_idx, "body_p_idx": body_idx, "style": None if style is None else style.get(W + "val"),
            "outline_lvl": None if level is None else int(level.get(W + "val", "0")), "location": place if kind == "document" else kind if self.note_id is None else f"{kind.removesuffix('s')}:{self.note_id}",
            **dict(zip(("tbl_idx", "row_idx", "cell_idx"), cell or (None,) * 3, strict=True)), "text": text, "text_model": text + "".join(gone),
            "text_search": "".join(self.searched), "mark_deleted": mark, "n_runs": self.r_idx, "n_child_runs": len(p.findall(W + "r")), "note_id": self.note_id,
            "has_revisions": revised, "has_unsupported": unsupported, "all_bold": bool(self.bold) and all(self.bold),
        })

    def inline(self, parent: ET.Element, state: dict) -> None:
        for e in parent:
            tag = e.tag.removeprefix(W)
            if tag == "r":
                self.run(e, state)
            elif tag in ("ins", "del", "moveFrom", "moveTo"):
                self.change(e, _texts(e, "t", "delText"), self.p_idx)
                self.inline(e, state | {"in_del" if tag in ("del", "moveFrom") else "in_ins": True, "change_id": e.get(W + "id"), "author": e.get(W + "author"), "date": e.get(W + "date")})
            elif tag == "hyperlink":
                self.emit("hyperlinks", {"part": self.name, "link_idx": self.link_idx, "p_idx": self.p_idx, "text": _texts(e, "t"), "anchor": e.get(W + "anchor"), "rel_id": e.get(R + "id")})
                self.link_idx += 1
                self.inline(e, state)
            elif tag == "fldSimple":
                self.put_field(e.get(W + "instr") or "", _texts(e, "t"), _flag(e.get(W + "dirty")))
                self.inline(e, state)
            elif tag == "bookmarkStart":
                self.emit("bookmarks", {"part": self.name, "name": e.get(W + "name"), "bookmark_id": e.get(W + "id"), "p_idx": self.p_idx, "preview": _texts(parent, "t")[:100]})
            elif tag == "commentRangeStart":
                self.open_comments[e.get(W + "id")] = [self.p_idx, []]
            elif tag == "commentRangeEnd":
                start, texts = self.open_comments.pop(e.get(W + "id"), [None, []])
                self.emit("comment_ranges", {"part": self.name, "comment_id": e.get(W + "id"), "start_p_idx": start, "end_p_idx": self.p_idx, "marked_text": "".join(texts)})
            elif tag in WRAPPING:
                self.inline(e, state)

    def put_field(self, code: str, display: str, dirty: bool = False) -> None:
        self.emit("fields", {"part": self.name, "dirty": dirty, "field_idx": self.field_idx, "p_idx": self.p_idx, "code": code.strip(), "display": display})
        self.field_idx += 1

    def run(self, r: ET.Element, state: dict) -> None:
        pieces = [x for x in r.iter() if x.tag in (_T, _DEL_TEXT)]
        text, gone = ("".join(x.text or "" for x in pieces if x.tag == tag) for tag in (_T, _DEL_TEXT))
        rpr = r.find(W + "rPr")
        props = _props(rpr)
        changed = None if rpr is None else rpr.find(W + "rPrChange")
        if changed is not None:
            self.change(changed, "", self.p_idx)
            props |= {"old_" + k: v for k, v in (_props(changed.find(W + "rPr")) or dict.fromkeys(("bold", "italic", "color"))).items()}
        for e in r:
            tag = e.tag.removeprefix(W)
            if tag == "fldChar":
                what = e.get(W + "fldCharType")
                if what == "begin":
                    self.field = ["", "", False, _flag(e.get(W + "dirty"))]
                elif self.field and what == "separate":
                    self.field[2] = True
                elif self.field and what == "end":
                    self.put_field(self.field[0], self.field[1], self.field[3])
                    self.field = None
            elif tag == "instrText" and self.field:
                self.field[0] += e.text or ""
            elif tag == "t" and self.field and self.field[2]:
                self.field[1] += e.text or ""
            elif tag in ("footnoteReference", "endnoteReference"):
                self.emit("note_refs", {"part": self.name, "note_kind": tag.removesuffix("Reference"), "note_id": e.get(W + "id"), "p_idx": self.p_idx})
            elif tag == "drawing":
                extent = next((x for x in e.iter() if x.tag.endswith("}extent")), None)
                blip = next((x for x in e.iter() if x.tag.endswith("}blip")), None)
                named = next((x for x in e.iter() if x.tag.endswith("}docPr")), None)
                self.emit("images", {"part": self.name, "p_idx": self.p_idx, "rel_id": None if blip is None else blip.get(R + "embed"), "width": None if extent is None else int(extent.get("cx")), "height": None if extent is None else int(extent.get("cy")), "name": None if named is None else named.get("name")})
        self.emit("runs", {"part": self.name, "note_id": self.note_id, "p_idx": self.p_idx, "r_idx": self.r_idx, "text": text, "del_text": gone, "in_ins": False, "in_del": False, **state, **props})
        self.r_idx += 1
        self.searched.append(text + gone)
        if text:
            self.bold.append(bool(props.get("bold")))
        for _, texts in self.open_comments.values():
            texts.append(text)


def parse(content: bytes, emit, kinds: frozenset[str] | None = None) -> None:
    """Calls emit(kind, row) for every entity of a package; what can't be read becomes an `errors` row. kinds: those that emit keeps, if not all."""
    try:
        package = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile as error:
        return emit("errors", {"part": None, "error": str(error)})
    for info in package.infolist():
        name = info.filename
        emit("parts", {"part": name, "size": info.file_size})
        if not name.endswith((".xml", ".rels")):
            continue
        own = "relationships" if name.endswith(".rels") else _LONE.get(name)
        if kinds is not None and own and not kinds & {own, "errors"}:
            continue
        try:
            root = ET.fromstring(package.read(name))
        except (ET.ParseError, zipfile.BadZipFile) as error:
            emit("errors", {"part": name, "error": str(error)})
            continue
        stem = name.rpartition("/")[2].rstrip("0123456789.xml")
        if name.endswith(".rels"):
            for e in root:
                emit("relationships", {"source_part": name.replace("_rels/", "").removesuffix(".rels"), "rel_id": e.get("Id"), "rel_type": (e.get("Type") or "").rpartition("/")[2], "target": e.get("Target"), "mode": e.get("TargetMode")})
        elif name == "[Content_Types].xml":
            for e in root:
                emit("content_types", {"part": e.get("PartName"), "extension": e.get("Extension"), "content_type": e.get("ContentType")})
        elif name == "word/document.xml":
            _Part(name, root, emit, kinds)
        elif name.startswith("word/") and stem in ("header", "footer"):
            _Part(name, root, emit, kinds)
            emit("headers_footers", {"part": name, "role": stem, "text": _texts(root, "t")})
        elif name in ("word/footnotes.xml", "word/endnotes.xml"):
            _Part(name, root, emit, kinds)
            for e in root:
                text = "\n".join(_texts(p, "t") for p in e.findall(W + "p")).lstrip(" ")
                emit("notes", {"note_kind": stem[:-1] if stem.endswith("s") else stem, "note_id": e.get(W + "id"), "w_type": e.get(W + "type"), "text": text})
        elif name == "word/comments.xml":
            for e in root:
                last = e.findall(W + "p")[-1:]
                emit("comments", {"comment_id": e.get(W + "id"), "author": e.get(W + "author"), "initials": e.get(W + "initials"), "date": e.get(W + "date"), "text": _texts(e, "t"), "para_id": last[0].get(W14 + "paraId") if last else None})
        elif name == "word/commentsExtended.xml":
            for e in root:
                emit("comment_ex", {"para_id": e.get(W15 + "paraId"), "parent_para_id": e.get(W15 + "paraIdParent"), "done": e.get(W15 + "done") in ("1", "true")})
        elif name == "word/styles.xml":
            for e in root.findall(W + "style"):
                title, based = e.find(W + "name"), e.find(W + "basedOn")
                emit("styles", {"style_id": e.get(W + "styleId"), "style_type": e.get(W + "type"), "name": None if title is None else title.get(W + "val"), "based_on": None if based is None else based.get(W + "val"), "hidden": e.find(W + "semiHidden") is not None})


def entities(found: DataFrame, *kinds: str) -> DataFrame:
    """(doc_id, kind, row): all entities of packages (doc_id, content), or those of some kinds; row is JSON of the kind's fields."""
    import json

    if unknown := set(kinds) - set(FIELDS):
        raise ValueError(f"unknown kinds of entities: {sorted(unknown)}")
    wanted = frozenset(kinds) or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows: list[tuple[str, str]] = []
                keep = lambda kind, row: rows.append((kind, json.dumps(row))) if wanted is None or kind in wanted else None  # noqa: E731, B023
                parse(content, keep, wanted)
                kinds, data = ([r[i] for r in rows] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(rows), pa.string()), pa.array(kinds, pa.string()), pa.array(data, pa.string())], names=["doc_id", "kind", "row"])

    return found.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, ROWS)


def entities_of_xml(parts: DataFrame) -> DataFrame:
    """(doc_id, kind, row) of bare main parts (doc_id, xml), as entities() gives of packages; what can't be read becomes an `errors` row."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, xml in zip(batch.column("doc_id").to_pylist(), batch.column("xml").to_pylist(), strict=True):
                rows: list[tuple[str, str]] = []
                emit = lambda kind, row: rows.append((kind, json.dumps(row)))  # noqa: E731, B023
                try:
                    root = ET.fromstring(xml or b"")
                except ET.ParseError as error:
                    emit("errors", {"part": "word/document.xml", "error": str(error)})
                else:
                    _Part("word/document.xml", root, emit)
                kinds, data = ([r[i] for r in rows] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(rows), pa.string()), pa.array(kinds, pa.string()), pa.array(data, pa.string())], names=["doc_id", "kind", "row"])

    return parts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("xml").cast("binary").alias("xml")).mapInArrow(run, ROWS)


# The encodings that packages may use.
ENCODINGS = ("UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE")


def part_problems(body: bytes) -> Iterator[tuple[str, str]]:
    """(rule, detail) for each rule of encodings, well-formedness and namespaces that a part breaks."""
    prolog = re.match(rb"\s*<\?xml[^>]*?encoding=[\"']([^\"']*)", body.replace(b"\0", b"")[:400].lstrip(b"\xef\xbb\xbf\xff\xfe"))
    if prolog and prolog[1].decode("latin-1").upper() not in ENCODINGS:
        yield "encoding", prolog[1].decode("latin-1")
    declared, root = set(), None
    try:
        for event, found in ET.iterparse(io.BytesIO(body), ["start-ns", "start"]):
            if event == "start-ns" and root is None:
                declared.add(found[0])
            elif event == "start" and root is None:
                root = found
    except (ET.ParseError, LookupError, ValueError) as error:
        yield "xml", str(error)
    for name, value in (root.attrib if root is not None else {}).items():
        if name.rpartition("}")[2] == "Ignorable":
            for prefix in sorted(set(value.split()) - declared):
                yield "namespace", prefix


def problems(found: DataFrame) -> DataFrame:
    """(doc_id, part, rule, detail): what parts of packages (doc_id, content) break: encoding, xml, namespace (a prefix that is to be ignored but isn't declared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    package = zipfile.ZipFile(io.BytesIO(content or b""))
                    rows += [(doc_id, n, *p) for n in package.namelist() if n.endswith((".xml", ".rels")) for p in part_problems(package.read(n))]
                except zipfile.BadZipFile as error:
                    rows.append((doc_id, None, "package", str(error)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["doc_id", "part", "rule", "detail"])

    return found.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, "doc_id string, part string, rule string, detail string")


def entity(found: DataFrame, kind: str) -> DataFrame:
    """One entity table of what entities() gave."""
    return found.where(F.col("kind") == kind).select("doc_id", F.from_json("row", FIELDS[kind]).alias("r")).select("doc_id", "r.*")


_TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>"""
_RELS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>"""


def escaped(text):
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def document_xml(runs: DataFrame, paragraphs: DataFrame, author: str = "Inkloom", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(doc_id, xml): a new main part, built from the runs and paragraph styles of one part by string expressions.

    Changes keep their author, date and id where runs have them. To save an edited package use `saved`, which keeps all else.
    """
    props = F.concat(F.when(F.col("bold"), F.lit("<w:b/>")).otherwise(""), F.when(F.col("italic"), F.lit("<w:i/>")).otherwise(""), F.when(F.col("color").isNotNull(), F.concat(F.lit('<w:color w:val="'), F.col("color"), F.lit('"/>'))).otherwise(""))
    rpr = F.when(props != "", F.concat(F.lit("<w:rPr>"), props, F.lit("</w:rPr>"))).otherwise("")
    body = lambda tag, c: F.concat(F.lit("<w:r>"), rpr, F.lit(f'<w:{tag} xml:space="preserve">'), escaped(F.col(c)), F.lit(f"</w:{tag}></w:r>"))
    own = lambda c, usual: F.coalesce(F.replace(escaped(F.col(c)), F.lit('"'), F.lit("&quot;")), F.lit(usual)) if c in runs.columns else F.lit(usual)
    mark = F.concat(F.lit(' w:id="'), F.coalesce("change_id", F.lit("0")), F.lit('" w:author="'), own("author", author), F.lit('" w:date="'), own("date", date), F.lit('">'))
    xml = (
        F.when(F.col("in_del"), F.concat(F.lit("<w:del"), mark, body("delText", "del_text"), F.lit("</w:del>")))
        .when(F.col("in_ins"), F.concat(F.lit("<w:ins"), mark, body("t", "text"), F.lit("</w:ins>")))
        .otherwise(body("t", "text"))
    )
    inside = runs.select("doc_id", "p_idx", F.struct("r_idx", xml.alias("xml")).alias("x")).groupBy("doc_id", "p_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["xml"]), "").alias("inside"))
    style = F.when(F.col("style").isNotNull(), F.concat(F.lit('<w:pPr><w:pStyle w:val="'), F.col("style"), F.lit('"/></w:pPr>'))).otherwise("")
    lines = paragraphs.select("doc_id", "p_idx", "style").join(inside, ["doc_id", "p_idx"], "left").select("doc_id", F.struct("p_idx", F.concat(F.lit("<w:p>"), style, F.coalesce("inside", F.lit("")), F.lit("</w:p>")).alias("xml")).alias("x"))
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["xml"]), "").alias("xml"))
    head = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W[1:-1]}"><w:body>'
    return whole.select("doc_id", F.concat(F.lit(head), F.col("xml"), F.lit("</w:body></w:document>")).alias("xml"))


def zipped(parts: DataFrame) -> DataFrame:
    """(doc_id, content): packages whose main part is xml."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for xml in batch.column("xml").to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as package:
                    for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", xml)):
                        package.writestr(zipfile.ZipInfo(name), text)
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return parts.select(F.col("doc_id").cast("string").alias("doc_id"), "xml").mapInArrow(run, "doc_id string, content binary")


def _walk_paragraphs(root: ET.Element):
    """Paragraphs of a part in the order of p_idx."""
    body = root.find(W + "body")
    todo = [iter(body if body is not None else root)]
    while todo:
        e = next(todo[-1], None)
        if e is None:
            todo.pop()
        elif e.tag == W + "p":
            yield e
        elif e.tag == W + "tbl":
            todo.append(iter([td for row in e.findall(W + "tr") for td in row.findall(W + "tc")]))
        elif e.tag in NESTING or e.tag == W + "tc":
            todo.append(iter(e))


def _walk_runs(parent: ET.Element):
    """(run, its parent) of a paragraph in the order of r_idx."""
    for e in list(parent):
        tag = e.tag.removeprefix(W)
        if tag == "r":
            yield e, parent
        elif tag in ("ins", "del", "moveFrom", "moveTo", "hyperlink", "fldSimple", *WRAPPING):
            yield from _walk_runs(e)


def _piece(run: ET.Element, row: dict) -> ET.Element:
    """A copy of a run with the text and properties of an edited one; of an inserted run only the look is copied."""
    out = copy.deepcopy(run)
    for e in list(out):
        if e.tag != W + "rPr" and (row["copied"] or e.tag in (W + "t", W + "delText")):
            out.remove(e)
    text = row["del_text"] or row["text"]
    if text:
        e = ET.SubElement(out, W + ("delText" if row["in_del"] else "t"))
        e.text = text
        e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    if row["formatted"]:
        props = out.find(W + "rPr")
        if props is None:
            props = ET.Element(W + "rPr")
            out.insert(0, props)
        before = [copy.deepcopy(x) for x in props if x.tag != W + "rPrChange"]
        for name, tag in (("bold", "b"), ("italic", "i")):
            for x in props.findall(W + tag):
                props.remove(x)
            if row[name] is not None:
                props.insert(0, ET.Element(W + tag, {} if row[name] else {W + "val": "0"}))
        if row["change_id"]:
            for x in props.findall(W + "rPrChange"):
                props.remove(x)
            ET.SubElement(ET.SubElement(props, W + "rPrChange", _marked(row)), W + "rPr").extend(before)
    return out


def _marked(row: dict) -> dict:
    return {W + "id": row["change_id"] or "0", W + "author": row["author"] or "", W + "date": row["date"] or ""}


def _put_runs(p: ET.Element, rows: list[dict]) -> None:
    """Puts a paragraph's edited runs, in order, where the runs that they come from stand."""
    runs = [r for r, _ in _walk_runs(p)] or [ET.SubElement(p, W + "r")]
    up = {child: parent for parent in p.iter() for child in parent}
    at: dict[int, list[dict]] = {}
    for row in rows:
        at.setdefault(row["src"], []).append(row)
    for i, run in enumerate(runs):
        mine = at.get(i, [])
        if len(mine) == 1 and mine[0]["same"]:
            continue
        outer = up[run]
        place = list(outer).index(run)
        behind = list(outer)[place + 1 :]
        outer.remove(run)
        new = [(row["fresh"] and row["copied"] and outer.tag in MARKS, _marked_piece(run, row)) for row in mine]
        if not any(own for own, _ in new):
            for _, e in reversed(new):
                outer.insert(place, e)
            continue
        # A new mark can't stand in another's: the old one is closed before it and goes on after it.
        for e in behind:
            outer.remove(e)
        above, inner = up[outer], outer
        spot = list(above).index(outer)
        for own, e in [*new, *((False, e) for e in behind)]:
            if own:
                spot += 1
                above.insert(spot, e)
                inner = None
                continue
            if inner is None:
                inner = ET.Element(outer.tag, outer.attrib)
                spot += 1
                above.insert(spot, inner)
                up[inner] = above
            inner.append(e)
            up[e] = inner
        if not len(outer):
            above.remove(outer)


def _marked_piece(run: ET.Element, row: dict) -> ET.Element:
    if row["same"]:
        return run
    piece = _piece(run, row)
    if not row["fresh"]:
        return piece
    outer = ET.Element(W + row["mark"], _marked(row))
    outer.append(piece)
    return outer


SAVED = "part, p_idx, r_idx, src, text, del_text, in_del, same, copied, fresh, mark, formatted, bold, italic, change_id, author, date"


SPLICED = "part, n, p_idx, root, side, fresh, removed, style, text, gone, ins_id, del_id, mark_id, author, del_author, date"


def saved(found: DataFrame, runs: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): packages with edited runs (operators.tracked) in place of the paragraphs' own, and with lines (operators.blocks) put in, taken out or marked.

    Only parts with edits are written anew, with their namespaces; every other part keeps its bytes. runs: all runs of
    each edited paragraph (tracked.changed_paragraphs); lines: blocks.spliced. A package and its edits meet in one row.
    """
    both = found.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    for edits, columns, name in ((runs, SAVED, "runs"), (lines, SPLICED, "lines")):
        if edits is None:
            both = both.withColumn(name, F.lit(None))
        else:
            packed = edits.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(*columns.split(", ")))).alias(name))
            both = both.join(packed, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("content", "runs", "lines")), strict=True)
            out = [_saved(c, r or [], x or []) if c and (r or x) else c for c, r, x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return both.mapInArrow(run, "doc_id string, content binary")


def _saved(content: bytes, runs: list[dict], lines: list[dict]) -> bytes:
    edited: dict[str, dict[int, list[dict]]] = {}
    for row in runs:
        edited.setdefault(row["part"], {}).setdefault(row["p_idx"], []).append(row)
    spliced: dict[str, list[dict]] = {}
    for row in lines:
        spliced.setdefault(row["part"], []).append(row)
    data = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            body, name = old.read(info.filename), info.filename
            new.writestr(info, _part_with(body, edited.get(name, {}), spliced.get(name, [])) if name in edited or name in spliced else body)
    return data.getvalue()


def namespaces(body: bytes) -> Iterator[tuple[str, str]]:
    """(prefix, uri) that a part declares; read up to its first element where nothing behind that declares any."""
    head = re.match(rb"(?:[^<]|<[?!])*<[^?!>](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", body)
    lone = head and b"\0" not in head[0] and b"xmlns" not in body[head.end() :]
    if lone:
        parser = ET.XMLPullParser(["start-ns"])
        parser.feed(body[: head.end()])
        parser.flush()
        events = parser.read_events()
    else:
        events = ET.iterparse(io.BytesIO(body), ["start-ns"])
    for _, found in events:
        yield found


def _part_with(body: bytes, edited: dict[int, list[dict]], lines: list[dict]) -> bytes:
    for prefix, uri in namespaces(body):
        if not (prefix.startswith("ns") and prefix[2:].isdigit()):
            ET.register_namespace(prefix, uri)
    root = ET.fromstring(body)
    paragraphs = list(_walk_paragraphs(root))
    for i, p in enumerate(paragraphs):
        if i in edited:
            _put_runs(p, edited[i])
    if lines:
        _splice(root, paragraphs, lines)
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def _splice(root: ET.Element, paragraphs: list[ET.Element], lines: list[dict]) -> None:
    """Puts new paragraphs beside those that they were put by, marks deleted paragraph marks, takes removed paragraphs out."""
    up = {child: parent for parent in root.iter() for child in parent}
    beside: dict[int, list[list[ET.Element]]] = {}
    for row in lines:  # in the order of n
        if row["fresh"] and not row["removed"]:
            beside.setdefault(row["root"], [[], []])[row["side"] > 0].append(_paragraph(row))
        elif row["p_idx"] is not None and row["mark_id"] and not row["removed"]:
            _mark_deleted(paragraphs[row["p_idx"]], row)
    for i, (ahead, behind) in beside.items():
        p = paragraphs[i]
        at = list(up[p]).index(p)
        for e in reversed(behind):
            up[p].insert(at + 1, e)
        for e in reversed(ahead):
            up[p].insert(at, e)
    for row in lines:
        if row["removed"] and row["p_idx"] is not None:
            p = paragraphs[row["p_idx"]]
            if up[p].tag == W + "tc" and len(up[p].findall(W + "p")) == 1:
                for e in [e for e in p if e.tag != W + "pPr"]:  # a cell keeps a paragraph
                    p.remove(e)
            else:
                up[p].remove(p)


def _paragraph(row: dict) -> ET.Element:
    p = ET.Element(W + "p")
    if row["style"]:
        ET.SubElement(ET.SubElement(p, W + "pPr"), W + "pStyle", {W + "val": row["style"]})
    outer = p
    if row["ins_id"]:
        outer = ET.SubElement(outer, W + "ins", _marked(row | {"change_id": row["ins_id"]}))
    if row["del_id"]:
        outer = ET.SubElement(outer, W + "del", _marked(row | {"change_id": row["del_id"], "author": row["del_author"]}))
    text = ET.SubElement(ET.SubElement(outer, W + "r"), W + ("delText" if row["del_id"] else "t"))
    text.text = row["gone"] if row["del_id"] else row["text"]
    text.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    if row["mark_id"]:
        _mark_deleted(p, row)
    return p


def _mark_deleted(p: ET.Element, row: dict) -> None:
    properties = p.find(W + "pPr")
    if properties is None:
        properties = ET.Element(W + "pPr")
        p.insert(0, properties)
    mark = properties.find(W + "rPr")
    if mark is None:
        mark = ET.Element(W + "rPr")
        # What may follow the mark's own properties.
        after = [i for i, e in enumerate(properties) if e.tag in (W + "sectPr", W + "pPrChange")]
        properties.insert(after[0] if after else len(properties), mark)
    if mark.find(W + "del") is None:
        mark.insert(0, ET.Element(W + "del", _marked(row | {"change_id": row["mark_id"], "author": row["del_author"]})))
