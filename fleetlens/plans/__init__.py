"""The three end-to-end questions: run state, ensemble plan, backlog."""
