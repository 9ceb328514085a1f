"""Readers, writers, state tables and scratch folders."""
