from . import auditing, authoring, handoff, intake, knowledge, projections, searching, streams, verification  # noqa: F401  (their queries join the registry)
