"""DataFrame-to-DataFrame operators, grouped by what they work on."""
