"""Composed jobs: daily collection, feature building, question answering."""
