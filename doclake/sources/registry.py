"""Reader registry: a plain value passed to a job, so two jobs never share state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import fixed

DocsReader = Callable[[DataFrame], DataFrame]

#: What a reader of one's own makes of its files: text that is shown as it is; markdown of a Word document; JSON, YAML or XML text; or
#: cells (doc_id, sheet, row_idx, col_idx, value, kind) of workbooks. All but text get the reports of their kind.
OUTPUTS = ("text", "markdown", "json", "yaml", "xml", "cells")


@dataclass(frozen=True)
class Reader:
    ext: str
    reader: str
    doc_type: str
    fence: str | None = None
    on_error: str = "reject"
    fn: DocsReader | None = None  # files of this extension (doc_id, content, …) → docs(doc_id, text), or cells
    output: str = "text"


@dataclass(frozen=True)
class Registry:
    readers: tuple[Reader, ...] = tuple(Reader(*row) for row in fixed.READERS)

    def register(self, ext: str, doc_type: str, fn: DocsReader, fence: str | None = None, output: str = "text") -> "Registry":
        """A new registry in which ``fn`` reads files of this extension; ``output`` tells what it makes of them."""
        if output not in OUTPUTS:
            raise ValueError(f"output must be one of {', '.join(OUTPUTS)}")
        ext = ext.lower()
        kept = tuple(r for r in self.readers if r.ext != ext)
        return replace(self, readers=kept + (Reader(ext, f"custom:{ext}", doc_type, fence, "reject", fn, output),))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The registry as a table; its size is that of the driver-side list."""
        rows = [(r.ext, r.reader, r.doc_type, r.fence, r.on_error) for r in self.readers]
        return spark.createDataFrame(rows, "ext string, reader string, doc_type string, fence string, on_error string")

    def extensions(self) -> list[str]:
        return sorted(r.ext for r in self.readers)

    def supports(self, ext: Column) -> Column:
        return F.lower(ext).isin(self.extensions())

    def lookup(self, ext: Column, field: str) -> Column:
        """A registry field for an extension, with the default reader for unknown ones.

        The table is a literal of the plan: no join, and it works on streams too.
        """
        default = next(getattr(r, field) for r in self.readers if r.ext == "default")
        out = None
        for value in dict.fromkeys(getattr(r, field) for r in self.readers):
            exts = [r.ext for r in self.readers if getattr(r, field) == value]
            hit = F.lower(ext).isin(exts)
            out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
        return out.otherwise(F.lit(default))


DEFAULT = Registry()
