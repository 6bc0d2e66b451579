"""Analytics over notes, source files and texts, written as Spark plans."""
