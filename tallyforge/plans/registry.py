"""All queries of the count-catalog operators with their SQL forms."""

from __future__ import annotations

from tallyforge.plans import analyse, classify, figure_frames

QUERIES: dict = {**classify.Q, **analyse.Q, **figure_frames.Q}
ORACLE: dict[str, str] = {**classify.SQL, **analyse.SQL, **figure_frames.SQL}
