"""Driver-side plans: job configuration, state, the next permitted step, and the steps themselves."""
