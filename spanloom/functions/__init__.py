"""Column functions and the few Arrow functions without a built-in form."""
