"""Planned-versus-actual schedule analytics as Spark jobs."""
