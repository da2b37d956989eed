"""A causal map and other tables written out: CSV, GraphML, one HTML page, the download log."""

from __future__ import annotations

import csv
import html
import json
import os
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import causal_map as M

# Columns of the files.
NODE_COLUMNS = ("node_id", "label", "role", "n_sentences", "as_cause", "as_effect", "n_papers", "shown", "n_members", "members")
EDGE_COLUMNS = ("edge_id", "source", "source_label", "target", "target_label", "n_papers", "n_sentences", "n_relations", "direction", "reciprocal", "self_loop", "drop_reason", "doc_ids", "rel_ids")
#: The page holds a map for reading; more edges than a reader's browser takes are refused, for files have no such limit.
MOST_PAGE_EDGES = 20_000


def _rows(df: DataFrame, columns: Iterable[str]):
    """Rows of a result file, partition by partition: one partition at a time is in the driver's memory."""
    return df.select(*columns).toLocalIterator()


def write_csv(df: DataFrame, path: str, columns: Iterable[str], name: str = "rows.csv") -> str:
    """One CSV file with a header and fixed columns; ``path`` is the file, or a folder that gets ``name``.

    Arrays come out joined.  For tables too large for one file there is :func:`write_csv_folder`.
    """
    path = path if path.endswith(".csv") else os.path.join(path, name)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(columns)
        for r in _rows(df, columns):
            w.writerow([" | ".join(map(str, v)) if isinstance(v, list) else v for v in r])
    return path


def write_csv_folder(df: DataFrame, folder: str, columns: Iterable[str]) -> str:
    """A folder of CSV parts with headers, written by all tasks side by side."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    df.select(*(F.array_join(c, " | ").alias(c) if c in arrays else F.col(c) for c in columns)).write.mode("overwrite").option("header", True).csv(folder)
    return folder


def _kind(df: DataFrame, column: str) -> str:
    return {"boolean": "boolean", "long": "long", "integer": "int", "double": "double"}.get(df.schema[column].dataType.typeName(), "string")


def _value(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else escape(str(v))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """GraphML with all nodes and all edges, shown ones first, every attribute with its type; streamed."""
    own = [c for c in NODE_COLUMNS[1:] if c in nodes.columns], [c for c in EDGE_COLUMNS if c in edges.columns and c not in ("edge_id", "source", "target")]
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for what, df, columns in (("node", nodes, own[0]), ("edge", edges, own[1])):
            for c in columns:
                f.write(f'<key id="{what}_{c}" for="{what}" attr.name="{c}" attr.type="{_kind(df, c)}"/>\n')
        f.write('<graph edgedefault="directed">\n')
        for r in _rows(nodes, ("node_id", *own[0])):
            data = "".join(f'<data key="node_{c}">{_value(r[c])}</data>' for c in own[0])
            f.write(f"<node id={quoteattr(r['node_id'])}>{data}</node>\n")
        for part in ("drop_reason = ''", "drop_reason <> ''"):
            for r in _rows(edges.where(part), ("edge_id", "source", "target", *own[1])):
                data = "".join(f'<data key="edge_{c}">{_value(r[c])}</data>' for c in own[1])
                f.write(f"<edge id={quoteattr(r['edge_id'])} source={quoteattr(r['source'])} target={quoteattr(r['target'])}>{data}</edge>\n")
        f.write("</graph>\n</graphml>\n")
    return path


def save_map(m: M.CausalMap, names: DataFrame, spans: DataFrame, folder: str) -> list[str]:
    """nodes.csv, edges.csv, hidden.csv and map.graphml of a map; ``spans`` ``(span, ord)`` give the order of members."""
    os.makedirs(folder, exist_ok=True)
    nodes = M.node_rows(m.nodes, names, spans)
    edges = M.edge_rows(M.number_edges(m.edges), m.nodes, m.evidence).orderBy("edge_id")
    return [
        write_csv(nodes, f"{folder}/nodes.csv", NODE_COLUMNS),
        write_csv(edges.where("drop_reason = ''"), f"{folder}/edges.csv", EDGE_COLUMNS),
        write_csv(edges.where("drop_reason <> ''"), f"{folder}/hidden.csv", EDGE_COLUMNS),
        write_graphml(nodes, edges, f"{folder}/map.graphml"),
    ]


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;display:flex;gap:1em}}svg{{border:1px solid #ccc}}line{{stroke:#999}}line.on{{stroke:#c30;stroke-width:3}}#side{{width:24em;height:{height}px;overflow:auto}}</style>
<div><h1>{title}</h1><form id="f">papers ≥ <input name="papers" type="number" value="1" size="3"> sentences ≥ <input name="sentences" type="number" value="1" size="3">
<label><input name="loops" type="checkbox" checked> loops</label> <label><input name="both" type="checkbox"> two-way only</label>
<select name="role"><option value="">all roles</option><option>cause only</option><option>effect only</option><option>cause and effect</option></select>
<select name="paper"><option value="">all papers</option></select> <input name="find" placeholder="find"></form><svg id="m" width="{height}" height="{height}"></svg></div><div id="side"></div>
<script>
const d={data};
const $=i=>document.getElementById(i),svg=$("m"),f=$("f"),H={height},label=Object.fromEntries(d.nodes.map(n=>[n.node_id,n.label]));
d.papers.forEach(p=>f.paper.append(new Option(p.source,p.doc_id)));
const roles=es=>{{const c=new Set(es.map(e=>e.source)),t=new Set(es.map(e=>e.target));return n=>c.has(n)?t.has(n)?"cause and effect":"cause only":"effect only"}};
function passing(){{let es=d.edges.filter(e=>e.n_papers>=+f.papers.value&&e.n_sentences>=+f.sentences.value&&(f.loops.checked||!e.self_loop)&&(!f.both.checked||e.reciprocal)&&(!f.paper.value||e.doc_ids.split(" | ").includes(f.paper.value)));
 if(f.role.value){{const r=roles(es);es=es.filter(e=>r(e.source)===f.role.value&&r(e.target)===f.role.value)}}return es}}
const add=(t,o,x)=>{{const e=document.createElementNS("http://www.w3.org/2000/svg",t);for(const k in o)e.setAttribute(k,o[k]);if(x)e.textContent=x;svg.append(e);return e}};
function evidence(e,line){{document.querySelectorAll("line.on").forEach(l=>l.classList.remove("on"));line.classList.add("on");const s=$("side");s.replaceChildren();const h=document.createElement("h2");h.textContent=label[e.source]+" → "+label[e.target];s.append(h);
 d.evidence.filter(v=>v.source===e.source&&v.target===e.target).forEach(v=>{{const p=document.createElement("p");p.textContent=(v.sentence||v.sent_id)+" ["+v.pairs+"; "+v.doc_id+"]";s.append(p)}})}}
function draw(){{svg.replaceChildren();const es=passing(),ns=[...new Set(es.flatMap(e=>[e.source,e.target]))],at={{}},want=f.find.value.toLowerCase();
 ns.forEach((n,i)=>{{const a=2*Math.PI*i/ns.length;at[n]=[H/2+H*.42*Math.cos(a),H/2+H*.42*Math.sin(a)]}});
 es.forEach(e=>{{const a=at[e.source],b=at[e.target],l=add("line",{{x1:a[0],y1:a[1],x2:b[0],y2:b[1]}});l.onclick=()=>evidence(e,l)}});
 ns.forEach(n=>add("text",{{x:at[n][0],y:at[n][1],"font-size":10,fill:want&&new RegExp("(^|[^a-z0-9])"+want.replace(/[^a-z0-9 ]/g,"\\$&")).test((label[n]||"").toLowerCase())?"#c30":"#000"}},(label[n]||"").split(" | ")[0].slice(0,40)))}}
f.oninput=draw;draw();
</script>
"""


def draw_map(m: M.CausalMap, path: str, papers: DataFrame | None = None, title: str = "Causal map", height: int = 720) -> str:
    """One self-contained page of the shown part of a map, with filters, roles, search and the evidence of each edge.

    ``papers`` ``(doc_id, doi, title)`` take the place of the map's own.
    """
    edges = M.edge_rows(M.number_edges(m.edges.where("drop_reason = ''")), m.nodes, m.evidence)
    if edges.limit(MOST_PAGE_EDGES + 1).count() > MOST_PAGE_EDGES:
        raise ValueError(f"more than {MOST_PAGE_EDGES} edges are too many for a page; raise min_papers or min_sentences")
    evidence = M.edge_sentences(m.evidence).join(edges.select("source", "target"), ["source", "target"], "left_semi")
    if "sentence" in m.evidence.columns:
        text = m.evidence.groupBy(F.coalesce("sent_id", "rel_id").alias("sent_id")).agg(F.min("sentence").alias("sentence"))
        evidence = evidence.join(text, "sent_id", "left")
    tables = {"nodes": m.nodes.where("shown"), "edges": edges, "evidence": evidence, "papers": M.source_label(papers if papers is not None else m.papers).select("doc_id", "source")}
    data = json.dumps({k: [r.asDict() for r in df.toLocalIterator()] for k, df in tables.items()}, default=str).replace("</", "<\\/")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PAGE.format(title=html.escape(title), data=data, height=height))
    return path
