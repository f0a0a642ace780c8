"""Programs in C, Java and C#: a tolerant parser, style counts, style rewrites, syntax and data-flow features."""
