"""A page of run history that needs no other file."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotab.operators.history import daily_points, latest_changes, shown_cells, signature_counts
from isotab.sources.sinks import make_result_sink

PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Table parity history</title><style>
body{font:15px/1.5 system-ui,sans-serif;margin:2rem;max-width:72rem}table{border-collapse:collapse;margin:.5rem 0}td,th{border:1px solid #bbb;padding:.15rem .5rem;text-align:left}
.ok{background:#dff3e4}.bad{background:#f8dcd9}.drift{outline:2px solid #c80}</style></head><body><h1>Table parity history</h1><div id="cases"></div>
<script>const DATA=__DATA__;
const root=document.getElementById("cases");
const add=(to,tag,text,cls)=>{const x=document.createElement(tag);if(text!==undefined)x.textContent=text;if(cls)x.className=cls;to.append(x);return x};
for(const [name,tables] of Object.entries(DATA)){add(root,"h2",name);
for(const {head,rows,marks} of tables){if(!rows.length)continue;const t=add(root,"table"),h=add(t,"tr");head.forEach(c=>add(h,"th",c));
rows.forEach((r,i)=>{const tr=add(t,"tr",undefined,marks&&marks[i]);r.forEach(c=>add(tr,"td",c===null?"":String(c)))})}}
</script></body></html>"""
POINT = ("day", "equivalent", "expected_rows", "actual_rows", "missing_count", "added_count", "changed_count", "drifted")


def history_tables(summary: DataFrame, diffs: DataFrame, days: int = 21, now: dt.datetime | None = None) -> dict[str, list[dict]]:
    """By case: the points of its days, the sets of columns that changed in its latest run, and the first changed cells."""
    points = daily_points(summary, days, now).persist()
    try:
        changes = latest_changes(points, diffs)
        signatures = signature_counts(changes).select("case_name", "n", F.array_join("columns", ", "), "example.key_json").orderBy("case_name", F.desc("n"), "key_json")
        blocks = (
            (POINT, points.select("case_name", F.col("day").cast("string").alias("day"), *POINT[1:]).orderBy("case_name", "day")),
            (("rows", "columns", "first key"), signatures),
            (("key", "column", "expected", "actual"), shown_cells(changes).orderBy("case_name", "key_json", "column")),
        )
        out: dict[str, list[dict]] = {}
        for head, df in blocks:
            for case, *cells in df.collect():
                tables = out.setdefault(case, [])
                if not tables or tables[-1]["head"] != list(head):
                    tables.append({"head": list(head), "rows": []})
                tables[-1]["rows"].append(cells)
                if head is POINT:
                    tables[-1].setdefault("marks", []).append(("ok" if cells[1] else "bad") + " drift" * bool(cells[-1]))
        return out
    finally:
        points.unpersist()


def render_html(tables: dict[str, list[dict]]) -> str:
    """All values go through textContent; the data can't end its script element."""
    return PAGE.replace("__DATA__", json.dumps(tables, default=str).replace("<", "\\u003c"))


def render_history(sink_spec: str, prefix: str = "isotab", days: int = 21) -> str:
    sink = make_result_sink(sink_spec, prefix=prefix)
    return render_html(history_tables(sink.read("run_summary"), sink.read("run_diffs"), days))
