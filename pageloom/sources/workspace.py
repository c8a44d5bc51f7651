"""Where a corpus keeps its parts, on any file system that Spark reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Folders below the root by what they hold.
FOLDERS = {
    "manifests": "00_manifests", "pdfs": "01_raw_pdfs", "sources": "03_tex_sources", "reports": "09_eval_reports/arxiv_2025_tex_compile", "scratch": "_tmp_arxiv_source_build",
}


@dataclass(frozen=True)
class Workspace:
    root: str

    def path(self, part: str, *more: str) -> str:
        """The path of a part of the corpus, or of something in it."""
        return "/".join([self.root.rstrip("/"), FOLDERS[part], *more])

    def ensure(self, spark: SparkSession) -> None:
        """Make the folders that aren't there."""
        for part in FOLDERS:
            place = spark._jvm.org.apache.hadoop.fs.Path(self.path(part))
            place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def replace_tree(spark: SparkSession, source: str, target: str) -> None:
    """``target`` becomes a copy of the tree ``source``; what was there goes once the copy is complete."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    old, new = hadoop.Path(target), hadoop.Path(target.rstrip("/") + "._new")
    here, there = hadoop.Path(source), old.getFileSystem(conf)
    there.delete(new, True)
    if not hadoop.FileUtil.copy(here.getFileSystem(conf), here, there, new, False, conf):
        raise OSError(f"{source} was not copied")
    there.delete(old, True)
    if not there.rename(new, old):
        raise OSError(f"{target} was not replaced")
