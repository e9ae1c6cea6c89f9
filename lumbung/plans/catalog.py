"""All registered queries."""

from lumbung.plans import (acquisition, documents, files, joins, linking,  # noqa: F401
                           outreach_events, planning, qualification, scalars, streaming)
from lumbung.plans.registry import ORACLES, QUERIES  # noqa: F401
