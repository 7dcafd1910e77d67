"""Relational, spatial, graph and scoring operators."""
