"""Connected components; the library's own, under the name that the corpus operators use."""

from quillspan.operators.groups import components

__all__ = ["components"]
