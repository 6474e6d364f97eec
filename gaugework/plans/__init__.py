"""Schema changes: their statements, the rules over them, verdicts and drift."""
