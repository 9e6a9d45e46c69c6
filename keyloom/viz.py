"""Diagrams of selected edges, which are few: DOT and Mermaid text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def _rows(edges: DataFrame) -> list[dict]:
    return sorted((r.asDict() for r in edges.collect()), key=lambda r: (-r["score"], r["fk_table"], r["fk_column"], r["pk_table"], r["pk_column"]))


def to_dot(edges: DataFrame, labels: bool = True) -> str:
    """Arrows from parents to children; dashed where optional or soft, wider for higher scores. Colours tell parents, children and both apart."""
    rows = _rows(edges)
    parents, children = {r["pk_table"] for r in rows}, {r["fk_table"] for r in rows}
    colour = {(True, False): "#d5e8d4", (False, True): "#dae8fc", (True, True): "#fff2cc"}
    out = ["digraph erd {", "  rankdir=LR;", "  node [shape=box, style=filled];"]
    out += [f'  "{t}" [fillcolor="{colour[t in parents, t in children]}"];' for t in sorted(parents | children)]
    for r in rows:
        style = "dashed" if r["optional"] or r.get("mode") == "soft" else "solid"
        label = f', label="{r["fk_column"]} -> {r["pk_column"]} ({r["score"]:.2f})"' if labels else ""
        out.append(f'  "{r["pk_table"]}" -> "{r["fk_table"]}" [style={style}, penwidth={1 + 4 * r["score"]:.2f}{label}];')
    out += ["  subgraph cluster_legend {", '    label="solid: required; dashed: optional or soft";', "  }", "}"]
    return "\n".join(out)


def _safe(name: str) -> str:
    s = re.sub(r"\W", "_", name) or "t"
    return f"t_{s}" if s[0].isdigit() else s


def to_mermaid(edges: DataFrame, columns: bool = True, most: int = 12) -> str:
    rows, out = _rows(edges), ["erDiagram"]
    if columns:
        keys: dict[str, set] = {}
        for r in rows:
            keys.setdefault(r["fk_table"], set()).add((r["fk_column"], "FK"))
            keys.setdefault(r["pk_table"], set()).add((r["pk_column"], "PK"))
        for t in sorted(keys):
            out += [f"  {_safe(t)} {{", *(f"    key {_safe(c)} {k}" for c, k in sorted(keys[t])[:most]), "  }"]
    for r in rows:
        link = "||--||" if r["cardinality"] == "one_to_one" else "||--o{"
        out.append(f'  {_safe(r["pk_table"])} {link} {_safe(r["fk_table"])} : "{r["fk_column"]}{" (optional)" if r["optional"] else ""}"')
    return "\n".join(out)
