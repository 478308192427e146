"""All queries of the core, and their SQL counterparts."""

from __future__ import annotations

from logloom.plans import dealt, reference

QUERIES = reference.QUERIES | dealt.QUERIES
ORACLE = reference.ORACLE | dealt.ORACLE
