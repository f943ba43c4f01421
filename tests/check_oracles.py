"""Compare all registered queries with their SQL: python tests/check_oracles.py SF_DIR [NAME ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import connect, difference  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from chatlens.session import build_session  # noqa: E402

sf_dir = sys.argv[1]
spark = build_session(
    master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false"
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
sqls = oracle_sql()
bad = 0
for name, query in queries().items():
    if sys.argv[2:] and name not in sys.argv[2:]:
        continue
    start = time.time()
    try:
        result = difference(query(spark, sf_dir), con, sqls[name]) if name in sqls else "no oracle"
    except Exception as error:
        result = f"{type(error).__name__}: {str(error)[:700]}"
    bad += result is not None
    print(f"{time.time() - start:6.2f} {name}: {result or 'ok'}", flush=True)
print("not ok:", bad)
