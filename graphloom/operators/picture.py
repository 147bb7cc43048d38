"""A graph as one HTML page: nodes on rings by degree, links, and the neighbourhood of a node that is clicked."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.render import visual
from graphloom.sources.files import Files

#: Nodes and links that a page shows at most: highlighted nodes first, then by degree.
SHOWN, LINKS = 1_500, 6_000
#: Colours by type of node, and of highlighted ones.
COLOURS = {"file": "#64748b", "function": "#2563eb", "method": "#0891b2", "class": "#9333ea", "constant": "#ca8a04", "import": "#94a3b8", "module": "#475569"}
LIT = "#dc2626"

PAGE = """<!doctype html><meta charset="utf-8"><title>__TITLE__</title>
<style>body{margin:0;font:13px sans-serif;background:#f8fafc}#note{position:fixed;left:12px;top:10px}canvas{display:block}</style>
<div id="note">__TITLE__ <span id="told"></span></div><canvas id="c"></canvas>
<script>
const data = __DATA__;
const canvas = document.getElementById("c"), pen = canvas.getContext("2d"), told = document.getElementById("told");
const byId = new Map(data.nodes.map(n => [n.id, n]));
let only = null;
function place() {
  canvas.width = innerWidth; canvas.height = innerHeight;
  const half = Math.min(innerWidth, innerHeight) / 2 - 60, n = data.nodes.length;
  data.nodes.forEach((v, i) => { const r = half * Math.sqrt((i + 1) / n), a = i * 2.39996; v.x = innerWidth / 2 + r * Math.cos(a); v.y = innerHeight / 2 + r * Math.sin(a); });
  draw();
}
function draw() {
  pen.clearRect(0, 0, canvas.width, canvas.height);
  const near = new Set(only ? [only] : []);
  if (only) for (const [a, b] of data.edges) { if (a === only) near.add(b); if (b === only) near.add(a); }
  pen.strokeStyle = "#cbd5e1";
  for (const [a, b] of data.edges) {
    if (only && a !== only && b !== only) continue;
    const x = byId.get(a), y = byId.get(b);
    pen.beginPath(); pen.moveTo(x.x, x.y); pen.lineTo(y.x, y.y); pen.stroke();
  }
  for (const v of data.nodes) {
    if (only && !near.has(v.id)) continue;
    pen.fillStyle = v.colour; pen.beginPath(); pen.arc(v.x, v.y, v.size / 2.5, 0, 7); pen.fill();
    if (only || v.highlighted || data.nodes.length < 80) { pen.fillStyle = "#0f172a"; v.label.split("\\n").forEach((t, k) => pen.fillText(t, v.x + v.size / 2, v.y + 12 * k)); }
  }
  told.textContent = only ? only : data.nodes.length + " nodes, " + data.edges.length + " links";
}
canvas.onclick = e => {
  const hit = data.nodes.find(v => Math.hypot(v.x - e.clientX, v.y - e.clientY) < v.size / 2);
  only = hit && hit.id !== only ? hit.id : null; draw();
};
onresize = place; place();
</script>
"""


def write_page(nodes: DataFrame, edges: DataFrame, highlighted: DataFrame, path: str, title: str = "graph") -> str:
    """Writes the page to path and returns it. A bounded part of the graph is shown, so only that comes to the driver."""
    kinds = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    looks = visual(nodes, edges, highlighted).join(nodes.select("id", "type"), "id")
    looks = looks.withColumn("colour", F.when(F.col("highlighted"), LIT).otherwise(F.coalesce(kinds[F.col("type")], F.lit("#64748b"))))
    shown = looks.orderBy(F.desc("highlighted"), F.desc("degree"), "id").limit(SHOWN).collect()
    ids = edges.sparkSession.createDataFrame([(r["id"],) for r in shown], "id string")
    inner = edges.join(F.broadcast(ids.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "target")), "target", "left_semi")
    links = inner.select("source", "target").distinct().orderBy("source", "target").limit(LINKS).collect()
    data = {"nodes": [{c: r[c] for c in ("id", "size", "label", "highlighted", "colour")} for r in shown], "edges": [[r["source"], r["target"]] for r in links]}
    safe = json.dumps(data).replace("<", "\\u003c")
    named = title.replace("&", "&amp;").replace("<", "&lt;")
    folder, name = path.rsplit("/", 1)
    Files(edges.sparkSession, folder).write(PAGE.replace("__TITLE__", named).replace("__DATA__", safe), name)
    return path
