"""All registered queries."""

from . import rates  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
from . import agreement  # noqa: F401
from . import corpora  # noqa: F401
from . import metrics  # noqa: F401
from . import reports  # noqa: F401
from . import runs  # noqa: F401
from . import planted  # noqa: F401
