"""Approximate set membership and counting over large key columns, on Spark."""
