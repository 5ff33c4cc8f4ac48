"""Sessions with the settings that the engine's results depend on."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive planning; anything else is the caller's."""
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(master).config(map=fixed | conf).getOrCreate()


def shipped(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once for each application; a session need not have it on its path.

    The archive lies in the shared folder that spark.checkpoint.dir names; where that is unset (tests), in a temporary one."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top, name = Path(__file__).resolve().parent, f"quantloom-{uuid.uuid4().hex[:8]}.zip"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    if shared := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared}/{name}")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data.getvalue()))
        out.close()
        sc.addPyFile(f"{shared}/{name}")
    else:
        archive = Path(tempfile.mkdtemp(prefix="quantloom-")) / name
        archive.write_bytes(data.getvalue())
        sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
