"""Reports for people: text of tables, with colours where the output is a terminal."""

from __future__ import annotations

import math
import os
import re
import sys
from dataclasses import dataclass

_ESCAPE = re.compile(r"\x1b\[[0-9;]*m")
_CODES = {"bold": 1, "dim": 2, "red": 31, "green": 32, "yellow": 33}


@dataclass
class Style:
    """Writes with or without colours."""

    on: bool

    @classmethod
    def detect(cls, out=None) -> Style:
        """On for a terminal, unless NO_COLOR is set."""
        out = out or sys.stdout
        return cls("NO_COLOR" not in os.environ and bool(getattr(out, "isatty", lambda: False)()))

    def __call__(self, kind: str, text: str) -> str:
        return f"\x1b[{_CODES[kind]}m{text}\x1b[0m" if self.on else text


def pad(text: str, width: int) -> str:
    """Spaces on the right up to a width in characters; colours have none."""
    return text + " " * max(0, width - len(_ESCAPE.sub("", text)))


def number(value: float | None, places: int) -> str:
    return "N/A" if value is None or not math.isfinite(value) else f"{value:.{places}f}"


def band(ms: float) -> str:
    """How a delay is coloured; a negative one is an error."""
    return "red" if ms < 0 or ms >= 20 else "green" if ms < 5 else "yellow"


def scan_lines(rows: list, counts: dict, stats: dict, method: str, residual: float, quality, style: Style, top: int = 0, quiet: bool = False) -> list[str]:
    """rows: link_id, src, dst, x, identifiable, largest delay first; top: how many of them, all for 0; quiet: only the rows."""
    shown = rows[:top] if top else rows
    out = []
    if not quiet:
        out += [style("bold", f"{method}: {counts['n_links']} links, {counts['n_identifiable']} identifiable ({100 * counts['identifiable_share']:.1f}%)")]
        out += [f"rank {quality.rank} of {quality.n}, condition {number(quality.condition, 1)}, residual {number(residual, 3)}", ""]
    out.append(style("dim", f"{pad('link', 6)} {pad('from', 22)} {pad('to', 22)} {pad('ms', 10)} identifiable"))
    for r in shown:
        value = style(band(r["x"]), f"{r['x']:.3f}") if r["identifiable"] else style("dim", f"{r['x']:.3f}")
        out.append(f"{pad(str(r['link_id']), 6)} {pad(str(r['src']), 22)} {pad(str(r['dst']), 22)} {pad(value, 10)} {'yes' if r['identifiable'] else style('yellow', 'NO')}")
    if not quiet:
        if len(shown) < len(rows):
            out.append(style("dim", f"{len(rows) - len(shown)} more"))
        out += ["", f"congested: {counts['n_congested']}", f"mean {number(stats['mean'], 3)} ms ± {number(stats['sd'], 3)}"]
    return out


def simulation_lines(rows: list, result: dict, style: Style) -> list[str]:
    """rows: link_id, src, dst, truth, x; result: a row of a benchmark."""
    out = [style("bold", f"{result['method']} on {result['n_links']} links and {result['n_paths']} paths"), style("dim", f"{pad('link', 6)} {pad('from', 18)} {pad('to', 18)} {pad('true ms', 10)} {pad('estimate', 10)} error")]
    for r in rows:
        off = r["x"] - r["truth"]
        out.append(f"{pad(str(r['link_id']), 6)} {pad(str(r['src']), 18)} {pad(str(r['dst']), 18)} {pad(number(r['truth'], 3), 10)} {pad(number(r['x'], 3), 10)} {style('green' if abs(off) < 1 else 'yellow' if abs(off) < 5 else 'red', f'{off:+.3f}')}")
    congested = sum(r["x"] > 20 for r in rows)
    return [*out, "", f"RMSE {number(result['rmse'], 3)} ms, MAE {number(result['mae'], 3)} ms", f"congested: {congested}, detected {100 * result['detection_rate']:.0f}% of the slowest"]


COLUMNS = (("topology", 18), ("solver", 12), ("nodes", 6), ("links", 6), ("paths", 7), ("rank", 6), ("cond", 9), ("RMSE", 9), ("MAE", 9), ("max rel", 9), ("ident", 6), ("ms", 9))


def benchmark_lines(results: list[dict], style: Style) -> list[str]:
    """The table of a benchmark over topologies: rows with topology and n_nodes beside a benchmark's columns."""
    out = [style("bold", " ".join(pad(n, w) for n, w in COLUMNS))]
    for r in results:
        rmse = number(r["rmse"], 3)
        color = "red" if rmse == "N/A" or r["rmse"] > 20 else "green" if r["rmse"] < 5 else "yellow"
        cells = [r["topology"], r["method"], r["n_nodes"], r["n_links"], r["n_paths"], r["rank"], number(r["condition"], 1), style(color, rmse), number(r["mae"], 3), number(r["max_rel_err"], 3), f"{100 * r['identifiable_share']:.0f}%", number(r["duration_ms"], 1)]
        out.append(" ".join(pad(str(c), w) for c, (_, w) in zip(cells, COLUMNS, strict=True)))
    return out


def plan_lines(rows: list, n_links: int, style: Style) -> list[str]:
    """rows: step, src, dst (labels), rank_gain, rank, gained."""
    out = [style("bold", f"{pad('step', 5)} {pad('from', 22)} {pad('to', 22)} {pad('gain', 5)} rank")]
    out += [f"{pad(str(r['step']), 5)} {pad(r['src'], 22)} {pad(r['dst'], 22)} {pad('+' + str(r['rank_gain']), 5)} {r['rank']}" for r in rows]
    rank = rows[-1]["rank"] if rows else 0
    return out if rank >= n_links else [*out, style("yellow", f"{n_links - rank} of {n_links} links stay unidentifiable")]
