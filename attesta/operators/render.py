"""Text and pages out of the graph: index documents, reading in pages, the graph as HTML."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, NAME = 12_000, 40


def own_text(sections: Column) -> Column:
    """The sections that are not quoted, or all of a pure forward."""
    own = F.filter(sections, lambda s: s["kind"] != "quoted")
    return F.array_join(F.transform(F.when(F.size(own) > 0, own).otherwise(sections), lambda s: s["text"]), "\n\n")


def read_page(documents: DataFrame, document_id: str, offset: int = 0) -> DataFrame:
    """text, next_offset (null at the end) of a document's text from a character on."""
    t = documents.where(F.col("document_id") == document_id).select(own_text(F.col("sections")).alias("t"))
    more = F.length("t") > offset + PAGE
    return t.select(F.substring("t", offset + 1, PAGE).alias("text"), F.when(more, F.lit(offset + PAGE)).alias("next_offset"))


def index_documents(documents: DataFrame, names: DataFrame) -> DataFrame:
    """document_id, version_id, text: header lines of the participants by role, under their graph names (email, name), and the own text."""
    p = documents.select("document_id", F.posexplode("participants").alias("i", "p")).select("document_id", "i", "p.role", F.lower("p.email").alias("email"), "p.name")
    p = p.join(names.toDF("email", "known"), "email", "left").withColumn("shown", F.coalesce("known", "name", "email"))
    lines = p.groupBy("document_id", "role").agg(F.sort_array(F.collect_list(F.struct("i", "shown"))).alias("x")).select("document_id", F.concat(F.col("role"), F.lit(": "), F.array_join(F.transform("x", lambda s: s["shown"]), ", ")).alias("line"), F.col("x")[0]["i"].alias("i"))
    heads = lines.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n").alias("head"))
    return documents.join(heads, "document_id", "left").select("document_id", "version_id", F.concat_ws("\n\n", F.concat_ws("\n", "title", "head"), F.nullif(own_text(F.col("sections")), F.lit(""))).alias("text"))


def graph_html(nodes: list[dict], edges: list[dict], title: str) -> str:
    """A page that needs nothing else: circles on a ring, lines, names. nodes: id, name, type. edges: source, target, relation."""
    cut = [{**n, "name": n["name"][:NAME]} for n in nodes]
    data = json.dumps({"nodes": cut, "edges": edges}).replace("<", "\\u003c")
    return f"""<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><style>body{{font:13px sans-serif;margin:0}}text{{font-size:11px}}</style><svg id="g" width="1000" height="1000"></svg><script>
const d={data},s=document.getElementById("g"),at={{}},ns="http://www.w3.org/2000/svg";
const put=(t,a,x)=>{{const e=document.createElementNS(ns,t);for(const k in a)e.setAttribute(k,a[k]);if(x)e.textContent=x;s.appendChild(e)}};
d.nodes.forEach((n,i)=>{{const w=2*Math.PI*i/d.nodes.length;at[n.id]=[500+420*Math.cos(w),500+420*Math.sin(w)]}});
d.edges.forEach(e=>{{const a=at[e.source],b=at[e.target];if(a&&b)put("line",{{x1:a[0],y1:a[1],x2:b[0],y2:b[1],stroke:"#aaa"}})}});
const hue=t=>[...t].reduce((h,c)=>(h*31+c.charCodeAt(0))%360,7);
d.nodes.forEach(n=>{{const p=at[n.id];put("circle",{{cx:p[0],cy:p[1],r:7,fill:`hsl(${{hue(n.type)}} 60% 50%)`}});put("text",{{x:p[0]+9,y:p[1]+4}},n.name)}});
</script>"""
