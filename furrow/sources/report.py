"""The HTML report of a quality control."""

from __future__ import annotations

import webbrowser
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.qc import SUMMARY, QCParams

#: A report shows at most so many flights, the worst first; its cards count all.
SHOWN = 1000


def flight_qc_report(summary: DataFrame, output_file: str = "flight_qc_report.html", title: str = "Flight quality control", params: QCParams = QCParams(), open_browser: bool = False) -> str:
    """Write a self-contained report of a QC summary and return its path."""
    if missing := [c for c in SUMMARY if c not in summary.columns]:
        raise ValueError(f"not a QC summary; it lacks {', '.join(missing)}")
    counts = summary.agg(F.count("*").alias("n"), F.avg("overall_score").alias("score"), *[F.count_if(F.col("recommendation") == g).alias(g) for g in ("Accept", "Caution", "Reject")]).first()
    rows = summary.select(*SUMMARY).orderBy("overall_score", "date", "label").limit(SHOWN).collect()
    cards = [("Flights", counts["n"]), ("Accept", counts["Accept"]), ("Caution", counts["Caution"]), ("Reject", counts["Reject"]), ("Mean score", "-" if counts["score"] is None else f"{counts['score']:.1f}")]
    cell = lambda v: "-" if v is None else "yes" if v is True else "no" if v is False else escape(str(v))
    table = "".join(f'<tr class="{escape(r["recommendation"])}">' + "".join(f"<td>{cell(r[c])}</td>" for c in SUMMARY) + "</tr>" for r in rows)
    limits = "".join(f"<tr><td>{escape(k)}</td><td>{cell(v)}</td></tr>" for k, v in vars(params).items())
    guide = "<li>Accept: 80 or more; use the flight.</li><li>Caution: 50 to 79; look at its flags first.</li><li>Reject: below 50; fly again.</li>"
    page = f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>
body{{font-family:sans-serif;margin:2em}} .card{{display:inline-block;border:1px solid #999;padding:.6em 1em;margin-right:.6em}}
table{{border-collapse:collapse;margin-top:1em}} td,th{{border:1px solid #ccc;padding:.2em .5em}} .Reject{{background:#f8d0d0}} .Caution{{background:#f8f0c8}} .Accept{{background:#d8f0d8}}
</style></head><body><h1>{escape(title)}</h1>{"".join(f'<div class="card"><b>{k}</b><br>{v}</div>' for k, v in cards)}
<table><tr>{"".join(f"<th>{c}</th>" for c in SUMMARY)}</tr>{table}</table><h2>Parameters</h2><table>{limits}</table><h2>Guide</h2><ul>{guide}</ul></body></html>"""
    with open(output_file, "w", encoding="utf-8") as f:
        f.write(page)
    if open_browser:
        webbrowser.open(output_file)
    return output_file
