"""The engine by requests: one JSON request on standard input, one JSON response on standard output, or an index command.

    python -m lorespark.cli --project DIR < request.json
    python -m lorespark.cli --project DIR --reindex | --add DIR | --remove-file PATH | --list
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import TextIO

from lorespark.api import Engine
from lorespark.session import local_session


def request_of(args: argparse.Namespace, stdin: TextIO) -> dict:
    if args.reindex:
        return {"action": "reindex"}
    if args.add:
        return {"action": "add_directory", "params": {"path": args.add}}
    if args.remove_file:
        return {"action": "remove_file", "params": {"path": args.remove_file}}
    if args.list:
        return {"action": "stats"}
    try:
        got = json.load(stdin)
    except ValueError as e:
        return {"action": None, "error": str(e)}
    return got if isinstance(got, dict) else {"action": None}


def main(argv: list[str] | None = None, stdin: TextIO = sys.stdin, stdout: TextIO = sys.stdout) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--project", default=".")
    p.add_argument("--reindex", action="store_true")
    p.add_argument("--list", action="store_true")
    p.add_argument("--add")
    p.add_argument("--remove-file")
    args = p.parse_args(argv)
    out = Engine(local_session(), args.project).execute(request_of(args, stdin))
    json.dump(out, stdout, default=str)
    return 0 if out.get("status") != "error" else 1


if __name__ == "__main__":
    sys.exit(main())
