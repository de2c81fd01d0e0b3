"""Makes the package known to Python workers, wherever the job was started."""

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: "weakref.WeakSet" = weakref.WeakSet()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's modules to all executors once a session (as spark-submit --py-files would); returns spark."""
    context = spark.sparkContext
    if context not in _shipped:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="modules-")) / "docaudit.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for module in sorted(package.rglob("*.py")):
                z.write(module, module.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context)
    return spark
