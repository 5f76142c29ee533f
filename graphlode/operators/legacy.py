"""What page scripts, classic pages and page controls hold, and what moving them takes.

Files are tables (``path``, ``content``).  Each function reads a file once: all its
patterns are tested in one projection and come out as rows of one generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlode.lineage import cut, dealt
from graphlode.operators.extract import all_of, named

QUOTED = """['"]([^'"]+)['"]"""
#: How a script reaches a control of its page or an address of its server; group 1 is the target (fixed values).
BRIDGE = {
    "selector": r"""(?i)\$\(\s*['"][^'"]*?\bid\$?=['"]?(\w+)""",
    "client_id": r"(?i)<%=\s*(\w+)\.ClientID\s*%>",
    "postback": r"(?i)__doPostBack\s*\(\s*" + QUOTED,
    "element": r"""(?i)document\.getElementById\s*\(\s*['"](\w+)['"]""",
    "ajax": r"(?i)\$\.ajax\(\s*\{[^}]*?\burl\s*:\s*" + QUOTED,
    "shorthand": r"(?i)\$\.(?:get|post|getJSON)\(\s*" + QUOTED,
    "fetch": r"(?i)\bfetch\(\s*" + QUOTED,
    "xhr": r"""(?i)\.open\(\s*['"](?:GET|POST|PUT|DELETE|PATCH)['"]\s*,\s*""" + QUOTED,
    "page_method": r"(?i)\bPageMethods\.([A-Za-z_]\w*)\s*\(",
}
#: Parts of maps by library; group 1 is the value (fixed values).
MAPS = {
    "google_maps": {"class": r"(?i)\bnew\s+google\.maps\.((?:drawing\.)?\w+)", "geometry": r"(?i)\bgoogle\.maps\.geometry\.(\w+)", "event": r"(?i)\bgoogle\.maps\.event\.(\w+)\s*\("},
    "leaflet": {"class": r"(?i)\bL\.(map|marker|tileLayer|circle|polygon|popup|polyline|layerGroup|featureGroup|geoJSON|icon|latLngBounds|latLng|markerClusterGroup)\s*\(", "tiles": r"(?i)\bL\.tileLayer(?:\.wms)?\s*\(\s*" + QUOTED, "crs": r"\bL\.CRS\.(\w+)"},
    "openlayers": {"class": r"(?i)\bnew\s+ol\.((?:layer|source|interaction)\.\w+|\w+)", "projection": r"(?i)\bol\.proj\.(\w+)"},
    "settings": {"zoom": r"(?i)\b(?:initial)?zoom(?:Level)?\s*[:=]\s*(\d{1,2})\b", "center": r"(?i)\bcenter\s*[:=]\s*\[?\s*(-?\d+\.?\d*\s*,\s*-?\d+\.?\d*)", "key": r"""(?i)\bapi_?key\s*[:=]\s*['"]([\w-]{20,})['"]"""},
}
BLOCKS = r"""(?is)<%.*?%>|<script[^>]+runat\s*=\s*["']server["'][^>]*>.*?</script>"""
#: What the server's code of a classic page does: kind and pattern; group 1 is the name (fixed values).
CLASSIC = {
    "function": r"(?im)(?:^|<%|>)\s*(?:public\s+|private\s+)?(?:sub|function)\s+(\w+)\s*\(",
    "state_write": r"""(?i)\b(?:session|application)\s*\(\s*["']([^"']+)["']\s*\)\s*=""",
    "state_read": r"""(?i)\b(?:session|application)\s*\(\s*["']([^"']+)["']\s*\)(?!\s*=)""",
    "request": r"""(?i)\brequest\s*\.\s*(?:querystring|form|cookies)\s*\(\s*["']([^"']+)["']""",
    "cookie_write": r"""(?i)\bresponse\s*\.\s*cookies\s*\(\s*["']([^"']+)["']""",
    "redirect": r"""(?i)\bresponse\s*\.\s*redirect\s*\(?\s*["']([^"']+)["']""",
    "transfer": r"""(?i)\bserver\s*\.\s*transfer\s*\(?\s*["']([^"']+)["']""",
    "object": r"""(?i)\bserver\s*\.\s*createobject\s*\(\s*["']([^"']+)["']""",
    "sql": r"""(?i)(?:\.\s*execute\s*\(\s*|\.?\s*\bcommandtext\s*=\s*)["']([^"']+)["']""",
}
INCLUDE = r"""(?i)<!--\s*#include\s+(?:file|virtual)\s*=\s*["']([^"']+)["']\s*-->"""
TABLES = r"(?i)\b(?:from|into|update|join)\s+\[?(\w+)\]?"
#: Page controls, what takes their place (Blazor, React, Angular) and the effort from 1 to 5 (fixed values).
CONTROLS = {
    "TextBox": ("InputText", "input", "input matInput", 1),
    "Label": ("span", "label", "label", 1),
    "Literal": ("MarkupString", "fragment", "innerHTML", 1),
    "Button": ("button", "button", "button mat-button", 1),
    "LinkButton": ("button", "button", "button mat-button", 1),
    "ImageButton": ("button with img", "button with img", "button mat-icon-button", 1),
    "HyperLink": ("NavLink", "Link", "routerLink", 1),
    "Image": ("img", "img", "img", 1),
    "CheckBox": ("InputCheckbox", "input checkbox", "mat-checkbox", 1),
    "RadioButtonList": ("InputRadioGroup", "radio group", "mat-radio-group", 2),
    "CheckBoxList": ("loop of InputCheckbox", "checkbox group", "mat-selection-list", 2),
    "DropDownList": ("InputSelect", "select", "mat-select", 2),
    "ListBox": ("InputSelect multiple", "select multiple", "mat-select multiple", 2),
    "Calendar": ("InputDate", "date picker", "mat-datepicker", 3),
    "FileUpload": ("InputFile", "input file", "input file", 3),
    "Panel": ("div", "div", "ng-container", 1),
    "PlaceHolder": ("RenderFragment", "children", "ng-content", 2),
    "MultiView": ("conditional markup", "conditional render", "ngSwitch", 3),
    "Wizard": ("stepper component", "stepper", "mat-stepper", 4),
    "Menu": ("NavMenu", "nav", "mat-menu", 3),
    "TreeView": ("recursive component", "tree", "mat-tree", 4),
    "GridView": ("QuickGrid", "data table", "mat-table", 4),
    "DataList": ("loop with template", "map of items", "ngFor", 3),
    "Repeater": ("loop with template", "map of items", "ngFor", 2),
    "ListView": ("Virtualize", "virtual list", "cdk-virtual-scroll", 3),
    "FormView": ("EditForm", "form", "reactive form", 4),
    "DetailsView": ("EditForm", "form", "reactive form", 4),
    "SqlDataSource": ("injected service", "query hook", "injected service", 5),
    "ObjectDataSource": ("injected service", "query hook", "injected service", 4),
    "UpdatePanel": ("component state", "component state", "component state", 4),
    "ScriptManager": ("none", "none", "none", 2),
    "RequiredFieldValidator": ("Required attribute", "schema validation", "Validators.required", 2),
    "RegularExpressionValidator": ("RegularExpression attribute", "schema validation", "Validators.pattern", 2),
    "ValidationSummary": ("ValidationSummary", "error list", "error list", 2),
}


def found(content: Column, patterns: dict[str, str]) -> Column:
    """Every match of every pattern as (``kind``, ``name``)."""
    return F.concat(*(named(content, k, p) for k, p in patterns.items()))


def bridge(files: DataFrame) -> DataFrame:
    """``path``, ``kind`` and ``name`` of what scripts reach; each once."""
    return files.select("path", F.inline(F.array_distinct(found(F.col("content"), BRIDGE))))


def map_parts(files: DataFrame) -> DataFrame:
    """``path``, ``library``, ``kind``, ``name`` of the maps in scripts, with how often; keys are known by their fingerprint only."""
    flat = {f"{library}/{kind}": p for library, kinds in MAPS.items() for kind, p in kinds.items()}
    # Files are dealt by path, so a task counts its own files and holds a bounded share of them.
    rows = dealt(files.select("path", "content"), "path").select("path", F.inline(found(F.col("content"), flat)))
    part = F.split("kind", "/")
    name = F.when(part[1] == "key", F.left(F.sha2("name", 256), F.lit(12))).otherwise(F.col("name"))
    return rows.select("path", part[0].alias("library"), part[1].alias("kind"), name.alias("name")).groupBy("path", "library", "kind", "name").agg(F.count("*").alias("n"))


def classic(files: DataFrame) -> DataFrame:
    """``path``, ``kind``, ``name`` from classic pages: their server blocks' acts, tables named in SQL, and includes; each once."""
    code = F.array_join(all_of(F.col("content"), BLOCKS, 0), "\n")
    acts = found(code, CLASSIC)
    sql = F.filter(acts, lambda a: a["kind"] == "sql")
    tables = F.flatten(F.transform(sql, lambda a: F.transform(all_of(a["name"], TABLES, 1), lambda t: F.struct(F.lit("table").alias("kind"), F.lower(t).alias("name")))))
    every = F.concat(acts, tables, found(F.col("content"), {"include": INCLUDE}))
    # Patterns cost far more than the rows they read: few files of a table must not mean few tasks.
    return dealt(files.select("path", "content"), "path").select("path", F.inline(F.array_distinct(every)))


def control_targets(pages: DataFrame) -> DataFrame:
    """Controls of pages (``path``, ``content``): uses and what takes their place; unknown ones have none."""
    used = pages.select("path", F.explode(all_of(F.col("content"), r"(?i)<asp:(\w+)", 1)).alias("control")).groupBy("control").agg(F.count("*").alias("uses"), F.count_distinct("path").alias("pages"))
    catalogue = F.create_map(*(x for name, (blazor, react, angular, effort) in CONTROLS.items() for x in (F.lit(name.lower()), F.struct(F.lit(blazor).alias("blazor"), F.lit(react).alias("react"), F.lit(angular).alias("angular"), F.lit(effort).alias("effort")))))
    return used.withColumn("x", F.try_element_at(catalogue, F.lower("control"))).select("control", "uses", "pages", "x.*")


def migration_slice(edges: DataFrame, nodes: DataFrame, start, carriers: list[str], classes: dict[str, str], depth: int = 4) -> DataFrame:
    """What a page takes with it: ``class``, ``node`` and least ``depth``.

    Edges (``src``, ``dst``, ``kind``) of the carriers' kinds are followed; from every
    node reached, each edge's target counts in its kind's class (``other`` without one).
    Dead nodes (``node``, ``dead``) are neither counted as reached nor followed.
    """
    dead = nodes.filter("dead").select("node")
    live = cut(edges.select("src", "dst", "kind").distinct().join(dead.toDF("src"), "src", "left_anti"), "slice-arcs")
    ways = live.filter(F.col("kind").isin(carriers)).select("src", "dst").join(dead.toDF("dst"), "dst", "left_anti").select("src", "dst").distinct()
    first = nodes.filter((F.col("node") == start) & ~F.col("dead")).select("node").distinct()
    seen = cut(first.withColumn("depth", F.lit(0)), "slice-seen")
    for step in range(1, depth + 1):
        front = seen.filter(F.col("depth") == step - 1).select(F.col("node").alias("src"))
        fresh = ways.join(front, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        fresh = cut(fresh.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)), "slice-front")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)), F.col("kind"))
    rows = live.join(seen.withColumnRenamed("node", "src"), "src")
    return rows.groupBy(F.coalesce(kind, F.lit("other")).alias("class"), F.col("dst").alias("node")).agg((F.min("depth") + 1).cast("int").alias("depth"))


def uncovered(candidates: DataFrame, indexes: DataFrame) -> DataFrame:
    """Wanted keys (``table_name``, ``equals``, ``then``) that no index (``table_name``, ``columns``) begins with.

    Columns compared for equality may come in any order, those after them in theirs.
    An index gives each of its beginnings as a row, so the check is an equi-join.
    """
    size = F.size("columns")
    heads = indexes.select("table_name", "columns", F.explode(F.sequence(F.lit(0), size)).alias("n"))
    heads = heads.select("table_name", "columns", "n", F.explode(F.sequence(F.lit(0), size - F.col("n"))).alias("m"))
    key = heads.select("table_name", F.array_sort(F.slice("columns", F.lit(1), F.col("n"))).alias("e"), F.slice("columns", F.col("n") + 1, F.col("m")).alias("t")).distinct()
    wanted = candidates.withColumn("e", F.array_sort("equals")).withColumn("t", F.col("then"))
    return wanted.join(key, ["table_name", "e", "t"], "left_anti").select(*candidates.columns)
