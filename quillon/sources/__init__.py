"""Where rows come from and indexes go: stores, markup, source code, paths."""
