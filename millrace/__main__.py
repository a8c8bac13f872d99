"""Command line: python -m millrace run SOURCE WORK OUTPUT, or single stages of a run."""

from __future__ import annotations

import argparse
import sys

from .plans import corpus
from .schemas import RunConfig
from .session import session

STAGES = ("scan", "extract", "chunk", "validate", "merge", "verify")


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 if a stage failed; its first failures are printed."""
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    parser.add_argument("stage", choices=(*STAGES, "run", "export-requests", "import-responses"))
    parser.add_argument("source"), parser.add_argument("work"), parser.add_argument("output")
    parser.add_argument("--enclave", help="folder of requests and responses of a recognition host")
    parser.add_argument("--chunk-target", type=int, default=RunConfig.chunk_target)
    parser.add_argument("--chunk-overlap", type=int, default=RunConfig.chunk_overlap)
    parser.add_argument("--max-file-bytes", type=int, default=RunConfig.max_file_bytes)
    parser.add_argument("--master", help="for a session of its own, outside spark-submit")
    args = parser.parse_args(argv)
    if args.stage in ("export-requests", "import-responses") and not args.enclave:
        parser.error("--enclave is needed")
    config = RunConfig(max_file_bytes=args.max_file_bytes, chunk_target=args.chunk_target, chunk_overlap=args.chunk_overlap)
    run = corpus.Run(session(args.master), args.source, args.work, args.output, config)
    steps = {name: getattr(run, name) for name in STAGES} | {"run": run.all, "export-requests": lambda: run.export_requests(args.enclave), "import-responses": lambda: run.import_responses(args.enclave)}
    try:
        made = steps[args.stage]()
    except corpus.StageFailed as failed:
        print(failed, *failed.failures[:10], sep="\n", file=sys.stderr)
        return 1
    print(f"{args.stage}: done" if made is None else f"{args.stage}: {made}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
