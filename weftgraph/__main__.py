"""python -m weftgraph SCHEMA_FILE TABLES_FOLDER 'MATCH ...': prints one JSON object per row.

python -m weftgraph serve SCHEMA_FILE TABLES_FOLDER [PORT]: answers queries over HTTP, on this machine only.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import GraphEngine, ParquetSource
from .service import QueryServer
from .sources import to_json_rows


def main(args: list[str]) -> int:
    serve = args[:1] == ["serve"]
    args = args[serve:]
    if len(args) not in ((2, 3) if serve else (3,)) or (serve and not "".join(args[2:] or ["0"]).isdecimal()):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = GraphEngine(spark, Path(args[0]).read_text(), ParquetSource(args[1]))
    if serve:
        server = QueryServer(engine, port=int(args[2]) if len(args) == 3 else 8080)
        print(f"http://{server.host}:{server.port}/api/query", flush=True)
        server.serve_forever()
    for row in to_json_rows(engine.execute(args[2], hydrate=True)):
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
