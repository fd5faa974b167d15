"""Live run state from arriving logs."""
