"""Results: tables, wide CSV, JSON documents, a page to look at."""

import html
import json
import os
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import guarded

# The columns of the wide report before those of the criteria.
COLUMNS = ("path", "status", "score", "rank", "similarity", "date", "date_source", "category", "summary", "exclusion_reason", "duplicate_of", "diversity_of")


def write_json(path: Path, value) -> None:
    """A JSON document that readers see whole or not at all."""
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with open(os.open(part, os.O_CREAT | os.O_WRONLY | os.O_EXCL, 0o600), "w") as stream:
        json.dump(value, stream, indent=1, default=str)
        stream.flush()
        os.fsync(stream.fileno())
    os.replace(part, path)


def wide(items: DataFrame, criteria: list[str]) -> DataFrame:
    """All items, a score and a reason column for each criterion; absent values are empty.

    ``items`` may have ``assessment``, a struct with category, summary,
    exclusion_reason and scores (a map of structs with score and reason).
    """
    has = set(items.columns)
    part = {"category", "summary", "exclusion_reason"}

    def value(name: str):
        if name in part and "assessment" in has:
            return F.col("assessment")[name]
        return F.col(name) if name in has else F.lit(None).cast("string")

    cells = [value(c).alias(c) for c in COLUMNS]
    for c in criteria:
        one = F.element_at(F.col("assessment")["scores"], F.lit(c))
        cells += [one["score"].alias(f"{c}_score"), one["reason"].alias(f"{c}_reason")]
    rows = items.select(*cells)
    return rows.select(*[guarded(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes])


def write_csv(items: DataFrame, criteria: list[str], path: str) -> None:
    wide(items, criteria).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def new_run(project: Path) -> Path:
    """A fresh, private folder for one run's results."""
    out = project / "results" / datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    out.mkdir(parents=True, mode=0o700)
    return out


def publish(project: Path, run: Path, recommended: int, requested: int) -> None:
    write_json(project / "latest.json", {"output": str(run), "recommended": recommended, "requested": requested})


_STYLE = (
    "body{font:16px/1.5 sans-serif;max-width:64rem;margin:2rem auto;padding:0 1rem}article{border-top:2px solid;padding:1rem 0}"
    "img{max-width:100%;max-height:44rem}td,th{padding:.4rem .8rem;text-align:left;vertical-align:top}.path{overflow-wrap:anywhere}"
)


def page(selected: list[dict], coverage: dict, variety: dict, requested: int, title: str = "Recommended items", thumbs: dict[int, str] | None = None) -> str:
    """An HTML page of the chosen items, at most as many as may be requested.

    ``thumbs`` names the picture of each rank, beside the page; a picture links to its file.
    """
    e = lambda v: html.escape(str(v), quote=True)
    out = [f'<!doctype html><html lang="en"><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>{e(title)}</title><style>{_STYLE}</style><h1>{e(title)}</h1>']
    seen = {k: coverage.get(k) for k in ("supported_images", "identity_matches", "read_errors")}
    out.append(f"<p>{len(selected)} of {requested} requested. " + ", ".join(f"{e(k.replace('_', ' '))}: {e(v)}" for k, v in seen.items()) + ".</p>")
    out.append("<p>" + ", ".join(f"{e(k.replace('_', ' '))}: {e(v)}" for k, v in variety.items()) + ". Unknown dates are under no day limit.</p>")
    if len(selected) < requested:
        out.append(f"<p>{requested - len(selected)} places stayed empty, as no further item met every rule; the table of all scores says why.</p>")
    for item in selected:
        rows = "".join(f"<tr><th>{e(n)}</th><td>{v['score']:.1f}</td><td>{e(v['reason'])}</td></tr>" for n, v in item.get("scores", {}).items())
        thumb = (thumbs or {}).get(item["rank"])
        shown = f'<a href="{e(Path(item["path"]).as_uri())}"><img src="{e(thumb)}" alt="{e(item["rank"])}"></a>' if thumb else ""
        out.append(
            f"<article><h2>#{e(item['rank'])} {item['score']:.2f} {e(item.get('category', ''))}</h2>{shown}<p>{e(item.get('summary', ''))}</p>"
            f'<p class="path">{e(item["path"])}</p><p>{e(item.get("date") or "unknown")} ({e(item.get("date_source", "unknown"))})</p>'
            f"<details><summary>Scores</summary><table>{rows}</table></details></article>"
        )
    return "".join(out) + "</html>"
