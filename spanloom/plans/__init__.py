"""Query registry: one key per operator, with its SQL where SQL can say it."""
