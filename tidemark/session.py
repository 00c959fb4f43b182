"""Session with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", **config: str) -> SparkSession:
    """UTC session time zone, adaptive execution; anything else by config (keys with _ for .)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in config.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so that Python workers can import it from any folder."""
    import io
    import tempfile
    import zipfile
    from pathlib import Path

    key = "tidemark.package.shipped"
    if spark.conf.get(key, None) == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="tidemark-")
    target = Path(folder) / "tidemark_package.zip"
    target.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set(key, spark.sparkContext.applicationId)
