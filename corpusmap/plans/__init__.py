"""Whole-catalogue plans and the registered queries."""
