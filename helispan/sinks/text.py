"""Text outputs as rows of lines, written by Spark's text writer."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def triangle_text(pairs: DataFrame, by: list[str], i: str, j: str, cell: Column) -> DataFrame:
    """``by, text``: the lower triangle of a matrix, a line for each row j of cells i <= j (K2, K4, K5)."""
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(i).alias("i"), cell.alias("t")))), lambda x: x["t"]), " ")
    rows = pairs.where(F.col(i) <= F.col(j)).groupBy(*by, j).agg(row.alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(j).alias("j"), "t"))), lambda x: x["t"]), "\n")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), text.alias("text"))


def with_header(texts: DataFrame, name: str) -> DataFrame:
    """``line``: a header of name and size before each triangle (K4)."""
    return texts.select(F.concat(F.format_string("%6s %4d\n", F.upper(name), "n"), "text").alias("line"))


def number_cell(value: Column, form: str = "%6.3f") -> Column:
    """A cell of a numeric matrix; no number prints as 0 (K4)."""
    return F.format_string(form, F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(value))


def result_lines(hits: DataFrame, key: str, score: str) -> DataFrame:
    """``id score`` lines (K8)."""
    return hits.select(F.format_string("%s %s", F.col(key).cast("string"), F.col(score).cast("string")).alias("line"))


def labelled_lines(hits: DataFrame, score: str, label: str) -> DataFrame:
    """Lines of scores and labels (K9)."""
    return hits.select(F.format_string("%20.8f  %d", F.col(score), F.col(label).cast("int")).alias("line"))


def edge_lines(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Tab-separated edges."""
    parts = [F.col("src").cast("string"), F.col("dst").cast("string")] + ([F.col(weight).cast("string")] if weight else [])
    return edges.select(F.concat_ws("\t", *parts).alias("line"))


def dot_text(edges: DataFrame, by: list[str]) -> DataFrame:
    """A graph description for each structure."""
    edge = F.format_string("  %s -- %s;", F.col("src").cast("string"), F.col("dst").cast("string"))
    return edges.groupBy(*by).agg(F.concat(F.lit("graph {\n"), F.array_join(F.sort_array(F.collect_list(edge)), "\n"), F.lit("\n}")).alias("text"))


def svg_elements(shapes: DataFrame) -> Column:
    """An SVG element of columns kind (rect, ellipse, line or text), x, y, width, height, fill and label.

    A line goes from its place by its width and height; labels are escaped.
    """
    rect = F.format_string('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f" fill="#%s"/>', "x", "y", "width", "height", "fill")
    ellipse = F.format_string('<ellipse cx="%.2f" cy="%.2f" rx="%.2f" ry="%.2f" fill="#%s"/>', "x", "y", F.col("width") / 2, F.col("height") / 2, "fill")
    line = F.format_string('<line x1="%.2f" y1="%.2f" x2="%.2f" y2="%.2f" stroke="#%s"/>', "x", "y", F.col("x") + F.col("width"), F.col("y") + F.col("height"), "fill")
    return F.when(F.col("kind") == "ellipse", ellipse).when(F.col("kind") == "line", line).when(F.col("kind") == "text", F.format_string('<text x="%.2f" y="%.2f">%s</text>', "x", "y", escaped(F.col("label")))).otherwise(rect)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def svg_connectors(connectors: DataFrame) -> Column:
    """An SVG connector of columns src, dst, src_port and dst_port."""
    return F.format_string('<path class="connector" data-src="%s" data-src-port="%s" data-dst="%s" data-dst-port="%s"/>', F.col("src").cast("string"), "src_port", F.col("dst").cast("string"), "dst_port")


def svg_clusters(members: DataFrame, by: list[str], name: str, fill: str) -> DataFrame:
    """``by, name, element``: an SVG group that lists a cluster's members in order."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), " ")
    return members.groupBy(*by, name, fill).agg(listed.alias("_m")).select(*by, name, F.format_string('<g class="cluster" data-name="%s" data-members="%s" fill="#%s"/>', F.col(name).cast("string"), "_m", fill).alias("element"))


def svg_constraints(places: DataFrame, by: list[str]) -> DataFrame:
    """``by, place, element``: an alignment constraint for the strands of each column, and its distance to the next."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string")), " ")
    return places.groupBy(*by, "place").agg(listed.alias("_m")).select(*by, "place", F.format_string('<constraint type="alignment" guide="%d" members="%s"/>', F.col("place").cast("long"), "_m").alias("element"))


def svg_documents(shapes: DataFrame, by: list[str], order: str) -> DataFrame:
    """``by, text``: an SVG document for each structure, its elements in order, sized by its bounding box."""
    d = shapes.withColumn("_e", svg_elements(shapes))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "_e"))), lambda x: x["_e"]), "\n")
    left, top = F.min(F.col("x") - F.col("width")), F.min(F.col("y") - F.col("height"))
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    box = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%.2f %.2f %.2f %.2f">\n', left, top, right - left, bottom - top)
    return d.groupBy(*by).agg(F.concat(box, body, F.lit("\n</svg>")).alias("text"))


def svg_drawing(shapes: DataFrame, clusters: DataFrame, connectors: DataFrame, constraints: DataFrame, by: list[str]) -> DataFrame:
    """``by, text``: an SVG document of a whole drawing, its elements numbered through, whose references are those numbers.

    ``shapes`` has id, kind, x, y (centre), width, height, fill and label; ``clusters`` cluster, id (of members) and fill; ``connectors``
    src, dst, x1, y1, x2, y2, src_port, dst_port and colour; ``constraints`` guide, axis and id (of the shapes aligned). Elements come in this order,
    each kind by its own names. A member or end that is no shape of the drawing is left out, as is what then refers to nothing.
    """
    parts = {"shapes": ["id", "kind", "x", "y", "width", "height", "fill", "label"], "clusters": ["cluster", "fill", "id"], "connectors": ["src", "dst", "x1", "y1", "x2", "y2", "src_port", "dst_port", "colour"], "constraints": ["guide", "axis", "id"]}
    tables = dict(zip(parts, (shapes, clusters, connectors, constraints), strict=True))
    rows = [tables[p].select(*by, *[(F.struct(*c) if p == q else F.lit(None)).alias(q) for q, c in parts.items()]) for p in parts]
    return svg_listed(reduce(DataFrame.unionByName, rows).groupBy(*by).agg(*[F.collect_list(p).alias(p) for p in parts]), by)


def svg_listed(drawings: DataFrame, by: list[str]) -> DataFrame:
    """What ``svg_drawing`` gives, for a row for each drawing: by and the arrays shapes, clusters, connectors and constraints of its columns.

    Each drawing is written in its row, so that nothing is sorted or joined again; drawings without shapes, or with a null in ``by``, are left out.
    """
    box = lambda s: (s["x"] - s["width"] / 2, s["y"] - s["height"] / 2)
    label = lambda x: escaped(F.coalesce(x.cast("string"), F.lit("")))
    rect = lambda s, n: F.format_string('<rect id="%d" class="%s" x="%.2f" y="%.2f" width="%.2f" height="%.2f" fill="#%s"><title>%s</title></rect>', n, s["kind"], *box(s), s["width"], s["height"], s["fill"], label(s["label"]))
    d = drawings.where(F.size("shapes") > 0).dropna(subset=by).withColumn("_s", F.sort_array("shapes"))
    ids = F.transform("_s", lambda s, i: F.struct(s["id"].alias("id"), (i + 1).alias("n")))
    d = d.select("*", ids.alias("_ids"), F.size("_s").alias("_n"))

    def numbers(name: Column) -> Column:
        return F.transform(F.filter("_ids", lambda s: s["id"] == name), lambda s: s["n"])

    def grouped(rows: str, names: list[str], sort: Callable[[Column], list[Column]], text: Callable[[Column, Column], Column]) -> Column:
        """The texts of groups of members that are shapes, in order."""
        same = lambda a, b: reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])
        heads = F.array_distinct(F.transform(rows, lambda r: F.struct(*[r[n].alias(n) for n in names])))
        listed = lambda h: F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter(rows, lambda r: same(r, h)), lambda r: numbers(r["id"])))))
        found = F.filter(F.transform(heads, lambda h: F.struct(h.alias("h"), listed(h).alias("m"))), lambda g: F.size(g["m"]) > 0)
        members = lambda g: F.array_join(F.transform(g["m"], lambda n: n.cast("string")), " ")
        return F.transform(F.sort_array(F.transform(found, lambda g: F.struct(*[c.alias(f"o{i}") for i, c in enumerate(sort(g["h"]))], text(g["h"], members(g)).alias("t")))), lambda g: g["t"])

    place = lambda n: F.lpad(n.cast("string"), 12, "0")
    path = lambda c, a, b: F.format_string('class="connector" d="M %.2f %.2f L %.2f %.2f" data-src="%d" data-src-port="%s" data-dst="%d" data-dst-port="%s" stroke="#%s"/>', c["x1"], c["y1"], c["x2"], c["y2"], a, c["src_port"], b, c["dst_port"], c["colour"])
    line = lambda c, a, b: F.struct(place(a).alias("a"), place(b).alias("b"), path(c, a, b).alias("t"))
    lines = F.flatten(F.transform("connectors", lambda c: F.flatten(F.transform(numbers(c["src"]), lambda a: F.transform(numbers(c["dst"]), lambda b: line(c, a, b))))))
    found = {
        "_g": grouped("clusters", ["cluster", "fill"], lambda h: [h["cluster"].cast("string")], lambda h, m: F.format_string('class="cluster" data-members="%s" fill="#%s"><title>%s</title></g>', m, h["fill"], escaped(h["cluster"].cast("string")))),
        "_path": F.transform(F.sort_array(lines), lambda c: c["t"]),
        "_constraint": grouped("constraints", ["guide", "axis"], lambda h: [place(h["guide"]), h["axis"]], lambda h, m: F.format_string('type="alignment" axis="%s" members="%s"/>', h["axis"], m)),
    }
    d = d.select(*by, "_s", "_n", *[c.alias(k) for k, c in found.items()])
    # Shapes keep the numbers that the others refer to; all others follow.
    element = lambda k, base: F.transform(k, lambda t, i: F.concat(F.lit(f'<{k[1:]} id="'), (base + i + 1).cast("string"), F.lit('" '), t))
    after = [F.col("_n"), F.col("_n") + F.size("_g"), F.col("_n") + F.size("_g") + F.size("_path")]
    body = F.concat(F.transform("_s", lambda s, i: rect(s, i + 1)), *[element(k, base) for k, base in zip(found, after, strict=True)])
    edges = [F.transform("_s", lambda s: box(s)[0]), F.transform("_s", lambda s: box(s)[1]), F.transform("_s", lambda s: s["x"] + s["width"] / 2), F.transform("_s", lambda s: s["y"] + s["height"] / 2)]
    ends = [F.array_min(e) for e in edges[:2]] + [F.array_max(e) for e in edges[2:]]
    d = d.select(*by, body.alias("_body"), *[e.alias(n) for e, n in zip(ends, ("_l", "_t", "_r", "_b"), strict=True)])
    view = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%.2f %.2f %.2f %.2f">\n', F.col("_l"), F.col("_t"), F.col("_r") - F.col("_l"), F.col("_b") - F.col("_t"))
    return d.select(*by, F.concat(view, F.array_join("_body", "\n"), F.lit("\n</svg>")).alias("text"))


def problem_lines(terms: DataFrame, key: str = "matrix") -> DataFrame:
    """The objective of a 0-1 problem for each key, terms in order of their variables."""
    term = F.format_string("%+d x%d", F.col("coefficient").cast("long"), F.col("variable").cast("long"))
    rows = F.sort_array(F.collect_list(F.struct(F.col("variable").alias("v"), term.alias("t"))))
    return terms.where("coefficient <> 0").groupBy(key).agg(F.concat(F.lit("min: "), F.array_join(F.transform(rows, lambda x: x["t"]), " "), F.lit(";")).alias("line"))


def constraint_lines(constraints: DataFrame, key: str = "matrix") -> DataFrame:
    """A line for each constraint, from rows key, constraint, variable, coefficient, bound (K17, M9): the sum is at most the bound."""
    term = F.format_string("%+d %s", F.col("coefficient").cast("long"), "variable")
    rows = F.sort_array(F.collect_list(F.struct(F.col("variable").alias("v"), term.alias("t"))))
    each = constraints.groupBy(key, "constraint", "bound").agg(F.array_join(F.transform(rows, lambda x: x["t"]), " ").alias("_t"))
    return each.select(key, "constraint", F.concat("_t", F.lit(" <= "), F.col("bound").cast("string"), F.lit(";")).alias("line"))


def lp_text(objective: DataFrame, constraints: DataFrame, variables: DataFrame, key: str = "matrix") -> DataFrame:
    """``key, text``: the whole problem in the second format, all variables declared binary."""
    goal = objective.select(key, F.regexp_replace(F.regexp_replace("line", "^min: ", ""), ";$", "").alias("goal"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("constraint", "line"))), lambda x: F.regexp_replace(x["line"], ";$", "")), "\n")
    rows = constraints.groupBy(key).agg(body.alias("body"))
    names = variables.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("variable")), " ").alias("names"))
    return goal.join(rows, key).join(names, key).select(key, F.concat(F.lit("Minimize\n"), "goal", F.lit("\nSubject To\n"), "body", F.lit("\nBinary\n"), "names", F.lit("\nEnd")).alias("text"))


def degree_cell(value: Column, own: Column) -> Column:
    """A cell of the old format (K3): degrees, and -999.0 on the diagonal and for no number."""
    return F.format_string("%7.1f", F.when(own | value.isNull() | F.isnan(value), F.lit(-999.0)).otherwise(F.degrees(value)))


def segment_info(segments: DataFrame, by: list[str]) -> DataFrame:
    """``by, text``: number of segments and a line for each with kind, chain and ends."""
    line = F.format_string("%s %s %s %s", F.when(F.col("kind") == "strand", "E").otherwise("H"), "chain", F.col("lo").cast("string"), F.col("hi").cast("string"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("chain", "lo", line.alias("t")))), lambda x: x["t"])
    return segments.groupBy(*by).agg(F.concat(F.count("*").cast("string"), F.lit("\n"), F.array_join(rows, "\n")).alias("text"))


def selection_script(segments: DataFrame, by: list[str]) -> DataFrame:
    """``by, text``: selections of segments for a molecule viewer's script, coloured by kind."""
    name = F.format_string("%s_%d", F.col("kind"), F.col("seg").cast("long"))
    line = F.format_string("select %s, chain %s and resi %d-%d\ncolor %s, %s", name, "chain", F.col("lo").cast("long"), F.col("hi").cast("long"), F.when(F.col("kind") == "strand", "yellow").otherwise("red"), name)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("seg", line.alias("t")))), lambda x: x["t"])
    return segments.groupBy(*by).agg(F.array_join(rows, "\n").alias("text"))


def plot_script(axes: DataFrame, by: list[str]) -> DataFrame:
    """``by, text``: a plotting script that draws each segment's axis (K14), from centre and direction."""
    point = lambda k: F.format_string("[%.3f %.3f]", F.col(f"centre.{k}"), F.col(f"centre.{k}") + F.col(f"direction.{k}"))
    line = F.format_string("plot3(%s,%s,%s)", point("x"), point("y"), point("z"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("seg", line.alias("t")))), lambda x: x["t"])
    return axes.where("centre is not null").groupBy(*by).agg(F.concat(F.lit("hold on\n"), F.array_join(rows, "\n")).alias("text"))


def index_html(names: DataFrame, by: list[str], name: str) -> DataFrame:
    """A page of links for each folder."""
    link = F.format_string('<li><a href="%s">%s</a></li>', name, name)
    return names.groupBy(*by).agg(F.concat(F.lit("<ul>\n"), F.array_join(F.sort_array(F.collect_list(link)), "\n"), F.lit("\n</ul>")).alias("text"))
