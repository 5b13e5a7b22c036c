"""Spark jobs for lakes of interleaved sensor logs; see README.md."""
