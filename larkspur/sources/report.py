"""An audit as one HTML file, and what a run was made with."""

from __future__ import annotations

import html
import os
import platform
import subprocess

from larkspur.operators.audit import AuditResult, audit_leakage
from larkspur.operators.diagnostics import calibration_plot
from larkspur.operators.resample import ResampleFit


def provenance(spark, git: bool = True) -> dict:
    """Versions, the machine, and the commit of the working folder."""
    out = {"spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), "cores": os.cpu_count(), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
    if git:
        try:
            out["commit"] = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            out["commit"] = None
    return out


def _cell(v) -> str:
    return f"{v:.6g}" if isinstance(v, float) else html.escape("" if v is None else str(v))


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>No results.</p>"
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def _bars(values: list[float], mark: float, width: int = 480, height: int = 120, bins: int = 20) -> str:
    """A histogram as inline SVG, with a line at mark."""
    values = [v for v in values if v is not None]
    if not values:
        return ""
    lo, hi = min([*values, mark]), max([*values, mark])
    step = (hi - lo) / bins or 1.0
    counts = [0] * bins
    for v in values:
        counts[min(bins - 1, int((v - lo) / step))] += 1
    w, top = width / bins, max(counts)
    bars = "".join(f'<rect x="{i * w:.1f}" y="{height - height * c / top:.1f}" width="{w - 1:.1f}" height="{height * c / top:.1f}"/>' for i, c in enumerate(counts))
    x = (mark - lo) / (hi - lo or 1.0) * width
    return f'<svg width="{width}" height="{height}" fill="#888">{bars}<line x1="{x:.1f}" x2="{x:.1f}" y1="0" y2="{height}" stroke="#c00" stroke-width="2"/></svg>'


def audit_report(audit: AuditResult | ResampleFit, path: str, calibration: list[dict] | None = None, confounders: list[dict] | None = None, about: dict | None = None) -> str:
    """Write the report; returns its path. A fit is audited first (its first learner, by its first metric). Duplicates are shown up to 50."""
    if isinstance(audit, ResampleFit):
        spec, metric = audit.info["refit"], audit.info["metrics"][0]
        learner = audit.predictions.agg({"learner": "min"}).first()[0]
        calibration = calibration or ([r.asDict() for r in calibration_plot(audit.predictions.where(f"learner = '{learner}'")).orderBy("bin").collect()] if audit.info["task"] == "binomial" else None)
        audit = audit_leakage(audit.predictions.drop("fold").withColumnRenamed("fold_seq", "fold"), spec["plan"], metric, audit.info["task"], learner=learner)
    dups = [r.asDict() for r in audit.duplicates.limit(50).collect()] if audit.duplicates is not None else []
    sections = [
        ("Summary", f"<pre>{html.escape(audit.describe())}</pre>" + _table(audit.mechanisms)), ("Permutation gap", _table([audit.permutation_gap]) + _bars(audit.perm_values, audit.permutation_gap["metric_obs"])),
        ("Folds and batches", _table(audit.batch_assoc)), ("Target scan", _table(audit.target_assoc)), ("Near duplicates", _table(dups)), ("Calibration", _table(calibration or [])), ("Confounders", _table(confounders or [])), ("Provenance", _table([about] if about else [])),
    ]
    body = "".join(f"<h2>{t}</h2>{s}" for t, s in sections)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><title>Audit</title><style>body{{font-family:sans-serif}}td,th{{padding:2px 8px;text-align:left}}</style><h1>Leakage audit</h1>{body}")
    return path
