"""Command line: python -m shutterstack.cli --catalog FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import shutil
import sys

from shutterstack.app import Catalog
from shutterstack.config import Config, load_config
from shutterstack.errors import CatalogError
from shutterstack.operators import dedup, search, transcode
from shutterstack.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shutterstack")
    p.add_argument("--catalog", default="catalog")
    p.add_argument("--config")
    commands = p.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    scan.add_argument("path")
    ingest = commands.add_parser("ingest")
    ingest.add_argument("--stages", help="comma-separated; all by default")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=20)
    find.add_argument("--type", dest="media_type")
    find.add_argument("--after")
    commands.add_parser("status")
    commands.add_parser("index")
    reembed = commands.add_parser("reembed")
    reembed.add_argument("model_id")
    reembed.add_argument("--version", default="1")
    serve = commands.add_parser("serve")
    serve.add_argument("--host")
    serve.add_argument("--port", type=int)
    dups = commands.add_parser("dedup")
    dups.add_argument("--tier", default="all")
    dups.add_argument("--threshold", type=float, default=dedup.THRESHOLD)
    commands.add_parser("transcode").add_argument("--run", action="store_true", help="transcode instead of only planning it")
    config = commands.add_parser("config")
    config.add_argument("key")
    config.add_argument("value", nargs="?")
    commands.add_parser("setup")
    return p


ALIASES = {"metadata": "extract_metadata", "frames": "extract_frames"}


def stages_of(text: str | None) -> tuple[str, ...]:
    """Stage names of a comma-separated list with short names; all stages without one."""
    every = ("extract_frames", "extract_metadata", "embed", "index")
    return tuple(ALIASES.get(s.strip(), s.strip()) for s in text.split(",")) if text else every


def run(args: argparse.Namespace, catalog: Catalog, config: Config, out=sys.stdout) -> int:
    say = lambda *x, **more: print(*x, file=out, **more)
    if args.command == "scan":
        say(json.dumps(catalog.scan(args.path), sort_keys=True))
    elif args.command == "ingest":
        say(json.dumps(catalog.ingest(stages_of(args.stages))))
    elif args.command == "search":
        given = {k: v for k, v in (("media_type", args.media_type), ("after", args.after)) if v}
        for r in search.display_table(catalog.search(args.query, args.limit, **given)).orderBy("rank").collect():
            say(r["rank"], r["score_text"], r["type_label"], r["dims"], r["id"])
    elif args.command == "index":
        say(catalog.build_index(), "lists")
    elif args.command == "status":
        say(json.dumps(catalog.stats() | catalog.progress() | {"last_scan_time": catalog.get("last_scan_time")}, sort_keys=True))
    elif args.command == "reembed":
        catalog.register_model(args.model_id, args.version)
        say(catalog.reembed(args.model_id, args.version), "jobs")
        catalog.ingest(("re_embed",))
    elif args.command == "dedup":
        for tier, rows in catalog.dedup(args.tier, args.threshold).items():
            for line in dedup.report_lines(tier, rows):
                say(line)
    elif args.command == "transcode":
        say(json.dumps(transcode.summary(catalog.transcode_plan(config.transcode)).first().asDict()))
        if args.run:
            say(catalog.enqueue_transcodes(config.transcode), "jobs")
            say(json.dumps(catalog.ingest(("transcode",))))
    elif args.command == "config":
        if args.value is not None:
            catalog.set(args.key, args.value)
        say(catalog.get(args.key))
    elif args.command == "setup":
        say(json.dumps({name: shutil.which(name) for name in ("ffmpeg", "ffprobe", "java")}))
    elif args.command == "serve":
        from shutterstack.http import serve

        serve(catalog, args.host or config.server.host, args.port or config.server.port)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config = load_config(args.config) if args.config else Config()
        return run(args, Catalog(build_session(), args.catalog, extraction=config.extraction, transcoding=config.transcode), config)
    except CatalogError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
