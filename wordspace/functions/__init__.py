"""Column expressions (JVM-side, codegen): vectors, logistic table, keyed draws."""
