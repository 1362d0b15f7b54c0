"""Part of the quern corpus engine."""
