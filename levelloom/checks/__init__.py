"""All registered queries; importing a module registers its queries."""

from levelloom.checks.registry import REGISTRY  # noqa: F401
from levelloom.checks import curation, documents, files, lighting, quality, repair, reports, series, streams, tokens  # noqa: F401
