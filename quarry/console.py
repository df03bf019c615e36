"""A search console over an engine: a query for each line, and commands that begin with a colon."""

from __future__ import annotations

from collections.abc import Callable

from quarry.plans.engine import SearchEngine

HELP = ":help, :stats, :top N (1 to 100), :quit; anything else is a query"


def run(engine: SearchEngine, read: Callable[[], str] = input, write: Callable[[str], None] = print, top: int = 10) -> None:
    """Answers lines until :quit, :exit or :q, or the end of input."""
    while True:
        try:
            line = read().strip()
        except EOFError:
            return
        command, _, rest = line.partition(" ")
        if command in (":quit", ":exit", ":q"):
            return
        if command == ":help":
            write(HELP)
        elif command == ":stats":
            for name, value in engine.stats().first().asDict().items():
                write(f"{name}: {value}")
        elif command == ":top":
            top = int(rest) if rest.isdigit() and 1 <= int(rest) <= 100 else top
            write(f"top {top}")
        elif line:
            for r in engine.search(line, top_k=top).collect():  # ``top`` rows
                write(f"{r.rank}. {r.company_name} ({r.score}) {r.address}")
