"""Letters as files: one text file per posting, named by its slug."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.functions.text import slugify


def write_letters(letters: DataFrame, path: str, title: str = "title", text: str = "letter") -> None:
    """Writes path/slug=<slug>/: the letters of each title. Letters with one title are files of one folder."""
    letters.select(slugify(F.col(title)).alias("slug"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("slug").text(path)
