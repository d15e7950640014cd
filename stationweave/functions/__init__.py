"""Pure Column expressions: no session, no action, JVM-side only."""
