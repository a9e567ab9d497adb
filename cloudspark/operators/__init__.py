"""Relational and grouped operators on point clouds."""
