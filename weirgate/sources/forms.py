"""Saved web forms to rows of controls: a table function over pages, the only part that parses HTML in Python."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from weirgate.functions import text as T
from weirgate.operators.matching import renumber_rows

SCAN = (
    "field_idx int, tag string, field_type string, name string, element_id string, label string, aria_label string, placeholder string, "
    "autocomplete string, accept string, required boolean, options array<string>, widget string"
)
FRAMES = "frame_idx int, src string"

# Elements and input types of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
IGNORED_TYPES = {"hidden", "submit", "button", "reset", "image"}
NATIVE = {"input", "select", "textarea"}


class Node:
    """An element: its tag, attributes, parent and children (elements and strings)."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def text(self) -> str:
        parts: list[str] = []
        todo = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                todo += reversed(x.children)
        return " ".join(" ".join(parts).split())

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo += [c for c in reversed(x.children) if isinstance(c, Node)]

    def ancestors(self) -> Iterator[Node]:
        x = self.parent
        while x is not None:
            yield x
            x = x.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("option", "li", "p") and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        for x in (self.at, *self.at.ancestors()):
            if x.tag == tag and x.parent is not None:
                self.at = x.parent
                return

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _is_combobox(n: Node) -> bool:
    return n.get("role") == "combobox" or n.get("aria-autocomplete") == "list" or (n.get("aria-haspopup") == "listbox" and n.tag not in NATIVE)


def _is_control(n: Node) -> bool:
    marked = n.get("role") in ("combobox", "listbox") or n.get("aria-haspopup") == "listbox" or n.get("aria-autocomplete") == "list"
    if n.tag not in NATIVE and not marked or n.tag in ("ul", "ol"):
        return False
    kind = n.get("type").lower() or "text"
    if n.tag == "input" and kind in IGNORED_TYPES:
        return False
    return not (n.get("aria-hidden").lower() == "true" and kind != "file")


class Page:
    """A parsed page with what labels need."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.nodes = list(self.root.walk())
        self.by_id = {n.get("id"): n for n in reversed(self.nodes) if n.get("id")}
        self.by_for = {n.get("for"): n for n in reversed(self.nodes) if n.tag == "label" and n.get("for")}

    def legend(self, n: Node) -> str:
        box = next((a for a in n.ancestors() if a.tag == "fieldset"), None)
        found = next((x for x in box.walk() if x.tag == "legend"), None) if box else None
        return found.text() if found else ""

    def wrapping(self, n: Node) -> str:
        found = next((a for a in n.ancestors() if a.tag == "label"), None)
        return found.text() if found else ""

    def container(self, n: Node, levels: int = 4) -> str:
        for _, box in zip(range(levels), n.ancestors(), strict=False):
            for x in box.walk():
                if x is n or not (x.tag in ("label", "legend") or "label" in x.get("class")):
                    continue
                if x.get("for") and x.get("for") != n.get("id"):
                    continue
                if text := x.text():
                    return text
        return ""

    def label(self, n: Node) -> str:
        """The first that is not empty: a label for it, labelled-by, the legend of a choice, a label around it, a legend, one nearby."""
        choice = n.tag == "input" and n.get("type").lower() in ("radio", "checkbox")
        own = self.by_for.get(n.get("id")) if n.get("id") else None
        named = " ".join(self.by_id[i].text() for i in n.get("aria-labelledby").split() if i in self.by_id)
        tries = (lambda: own.text() if own else "", lambda: named, lambda: self.legend(n) if choice else "", lambda: self.wrapping(n), lambda: self.legend(n), lambda: self.container(n))
        return next((x for t in tries if (x := t())), "")

    def options(self, n: Node) -> list[str]:
        if n.tag == "select":
            return [t for x in n.walk() if x.tag == "option" and (t := x.text())]
        if n.tag == "input" and n.get("type").lower() in ("radio", "checkbox"):
            own = self.by_for.get(n.get("id"))
            text = self.wrapping(n) or (own.text() if own else "")
            return [text] if text else []
        box = self.by_id.get(n.get("aria-controls") or n.get("aria-owns"))
        return [t for x in (box.walk() if box else ()) if x.get("role") == "option" and (t := x.text())]

    def controls(self) -> Iterator[tuple]:
        for i, n in enumerate(x for x in self.nodes if _is_control(x)):
            kind = (n.get("type").lower() or "text") if n.tag == "input" else n.tag
            required = "required" in n.attrs or n.get("aria-required").lower() == "true"
            yield (i, n.tag, kind, n.get("name"), n.get("id"), self.label(n), n.get("aria-label"), n.get("placeholder"), n.get("autocomplete"), n.get("accept"), required, self.options(n), "combobox" if _is_combobox(n) else "native")

    def frames(self) -> list[str]:
        return [n.get("src") for n in self.nodes if n.tag in ("iframe", "frame")]


@udtf(returnType=SCAN)
class ScanForm:
    def eval(self, html: str):
        yield from Page(html or "").controls()


@udtf(returnType=FRAMES)
class ScanFrames:
    def eval(self, html: str):
        yield from enumerate(Page(html or "").frames())


def scan_forms(pages: DataFrame, id_col: str = "form_id", html_col: str = "html") -> DataFrame:
    """One row per control, in document order, with repeating groups and date parts named."""
    rows = pages.select(F.col(id_col).alias("form_id"), F.col(html_col).alias("html"))
    return name_groups(_lateral(rows, ScanForm, "html").drop("html"))


def _lateral(rows: DataFrame, function, column: str) -> DataFrame:
    """rows with what a table function gives for each, under names that only this call uses."""
    spark, name = rows.sparkSession, f"weirgate_{uuid.uuid4().hex}"
    spark.udtf.register(f"{name}_f", function)
    rows.createOrReplaceTempView(name)
    out = spark.sql(f"SELECT p.*, f.* FROM {name} p, LATERAL {name}_f(p.{column}) f")
    spark.catalog.dropTempView(name)
    return out


def scan_with_frames(pages: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """The controls of saved pages and of the saved frames within them: form_id (the root's path), frame_path, then as scan_forms.

    Controls are numbered through a page, then its frames in order; groups are named over the whole form."""
    found = frame_walk(pages, roots, depth).join(pages.select("path", "html"), "path")
    scanned = _lateral(found.select(F.col("root").alias("form_id"), "frame_path", "html"), ScanForm, "html").drop("html")
    order = Window.partitionBy("form_id").orderBy("frame_path", "field_idx")
    return name_groups(scanned.withColumn("field_idx", F.row_number().over(order) - 1))


def contexts(scanned: DataFrame) -> DataFrame:
    """form_id, contexts: in how many documents (the page and its frames) a form's controls lie."""
    return scanned.groupBy("form_id").agg(F.countDistinct("frame_path").alias("contexts"))


def name_groups(fields: DataFrame) -> DataFrame:
    """Adds grp, grp_index (dense from 0 within a form's group); a label of split dates gets its part."""
    by_id, by_name = T.group_parse(F.col("element_id")), T.group_parse(F.col("name"))
    g = F.when(by_id["grp"] != "", by_id).otherwise(by_name)
    raw = fields.withColumn("g", g).withColumn("label", date_part_label(F.col("label"), F.col("aria_label")))
    index = F.when(F.col("g.grp") == "", F.lit(-1)).otherwise(renumber_rows(raw, ["form_id", "g.grp"], "g.grp_index"))
    return raw.select("*", F.col("g.grp").alias("grp"), index.cast("int").alias("grp_index")).drop("g")


def date_part_label(label, aria):
    part = F.lower(F.trim(aria))
    lacks = part.isin("month", "year", "day") & (label != "") & ~F.contains(F.lower(label), part)
    return F.when(lacks, F.concat(label, F.lit(" "), F.trim(aria))).otherwise(label)


def local_frame(base, src):
    """The file that a frame's source names beside its page, or null if it is remote or no file."""
    path = F.regexp_replace(src, "[?#].*$", "")
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)  # a stray % stays
    remote = F.lower(src).rlike(r"^(https?:|//|data:|about:)") | (path == "")
    return F.when(~remote, F.concat(F.regexp_replace(base, "[^/]*$", ""), path))


def frame_walk(pages: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """root, path, frame_path (indices from the root): pages and the saved frames within them, to a depth. pages: path, html."""
    listed = _lateral(pages.select(F.col("path").alias("base"), "html"), ScanFrames, "html")
    edges = listed.select("base", "frame_idx", local_frame(F.col("base"), F.col("src")).alias("target"))
    edges = edges.join(pages.select(F.col("path").alias("target")), "target", "left_semi")  # frames that cannot be resolved keep their index
    level = roots.select(F.col("path").alias("root"), "path", F.array().cast("array<int>").alias("frame_path"))
    out = level
    for _ in range(depth):
        level = level.join(edges, F.col("path") == F.col("base")).select("root", F.col("target").alias("path"), F.concat("frame_path", F.array("frame_idx")).alias("frame_path"))
        out = out.unionByName(level)
    return out
